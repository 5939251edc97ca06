"""Content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(material: Column, length: int) -> Column:
    return F.substring(F.sha2(material, 256), 1, length)


def _joined(*parts: Column) -> Column:
    # concat_ws would drop a null part together with its separator.
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def opaque_id(*parts: Column) -> Column:
    return F.concat(F.lit("play-"), _digest(_joined(*parts), 16))


def doc_id(title: Column) -> Column:
    return F.concat(F.lit("doc_"), _digest(title, 12))


def draft_id(to: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("draft_"), _digest(_joined(to, subject, F.substring(body, 1, 200)), 12))


def message_id(to: Column, subject: Column, body: Column) -> Column:
    material = _joined(F.lit("send"), to, subject, F.substring(body, 1, 200))
    return F.concat(F.lit("msg_"), _digest(material, 12))
