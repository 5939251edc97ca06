"""Operators on the small fixtures: sparse weeks, ties, odd labels, gates, ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxboard.model import RUN_SCHEMA, VOCABULARY
from voxboard.operators import (
    evidence,
    gates,
    joins,
    ledger,
    metrics,
    ranking,
    report,
    sampling,
    scrub,
    themes,
    windows,
)
from voxboard.operators.budget import rolling_budget
from voxboard.operators.quality import filter_quality

AS_OF = "2026-09-08"
KEYS = ["product_id"]
REVIEW = "product_id string, id string, source string, rating double, title string, text string, date date, language string"


def day(ago):
    return dt.date(2026, 9, 8) - dt.timedelta(days=ago)


def review(id, text, rating=1.0, ago=3, source="play", language="en", product="p"):
    return (product, id, source, rating, None, text, day(ago), language)


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEW)


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


GOLDEN = [
    review("play-a", "The app crashes after the latest update and charts freeze."),
    review("play-b", "I cannot sell my shares and the stop-loss never triggers."),
    review("play-c", "Customer support never replies to my ticket about funding delays."),
]
ACTIONS = [
    "Prioritize crash regressions from low-rated reviews this week.",
    "Trace sell and stop-loss failures end to end.",
    "Publish support ticket SLAs for funding escalations.",
]
TOP = ["app_reliability", "trading_orders", "customer_support"]


def test_sparse_window_is_widened(spark):
    rows = [review(f"play-{i}", "The trading app failed my sell order again.", ago=70) for i in range(8)]
    row = windows.resolve_window(reviews(spark, rows), 8, AS_OF, KEYS).first()
    assert (row.weeks_used, row.in_window, row.window_widened, row.insufficient_signal) == (12, 8, True, True)
    kept = windows.adaptive_window(reviews(spark, rows), 8, AS_OF, KEYS)
    assert kept.count() == 8


@pytest.mark.parametrize("ages, want", [([10] * 30, 8), ([10] * 29 + [60], 9), ([10] * 29 + [80], 12)])
def test_window_stops_at_the_first_width_with_enough_rows(spark, ages, want):
    rows = [review(f"play-{i}", "text", ago=a) for i, a in enumerate(ages)]
    assert windows.resolve_window(reviews(spark, rows), 8, AS_OF, KEYS).first().weeks_used == want


def test_spam_is_dropped(spark):
    rows = [review("a", "good"), review("b", "one two three four five six seven eight is fine")]
    kept = filter_quality(reviews(spark, rows), F.lit(True))
    assert [r.id for r in kept.collect()] == ["b"]


def test_unknown_labels_fold_into_the_default(spark):
    df = spark.createDataFrame([("a", "onboarding"), ("b", "trading_orders"), ("c", None)], "id string, theme_id string")
    assert column(themes.fold_unknown(df), "theme_id", "id") == ["app_reliability", "trading_orders", "app_reliability"]


def test_severity_ranking_of_known_figures(spark):
    rows = [
        ("p", "app_reliability", 588, 202, 3.44),
        ("p", "trading_orders", 361, 166, 2.92),
        ("p", "customer_support", 105, 88, 1.63),
        ("p", "fees_funding", 138, 75, 2.65),
        ("p", "charts_market_data", 34, 19, 2.47),
    ]
    df = spark.createDataFrame(rows, "product_id string, theme_id string, review_count long, low_star_count long, avg_rating double")
    assert column(themes.rank_themes(df, KEYS), "theme_id", "rank") == TOP


def test_severity_ties(spark):
    rows = [
        ("p", "b", 10, 2, 3.0), ("p", "a", 10, 2, 3.0), ("p", "c", 11, 2, 4.0),
        ("p", "d", 10, 2, None), ("p", "e", 10, 2, 2.9),
    ]
    df = spark.createDataFrame(rows, "product_id string, theme_id string, review_count long, low_star_count long, avg_rating double")
    assert column(themes.rank_themes(df, KEYS, 5), "theme_id", "rank") == ["c", "e", "a", "b", "d"]


def test_missing_ratings(spark):
    rows = [review("play-1", "x", None), review("play-2", "x", 4.0), review("play-3", "x", 2.5), review("play-4", "x", 2.0)]
    df = reviews(spark, rows).withColumn("theme_id", F.lit("fees_funding"))
    row = themes.aggregate_themes(df, KEYS).first()
    assert (row.review_count, row.avg_rating, row.low_star_count) == (4, 2.833, 1)
    assert row.sample_ids == ["play-4", "play-3", "play-2", "play-1"]
    assert row.summary == "4 reviews; 1 rated ≤2★"


def test_first_copy_wins(spark):
    rows = [
        ("p", "f2", 1, day(1), 1.0, "same", "later"),
        ("p", "f1", 9, day(1), 1.0, "same", "first"),
        ("p", "f1", 10, day(1), None, "same", "other rating"),
        ("q", "f1", 11, day(1), 1.0, "same", "other product"),
    ]
    df = spark.createDataFrame(rows, "product_id string, src_file string, src_pos long, date date, rating double, text string, title string")
    kept = sampling.dedupe_reviews(df)
    assert sorted(column(kept, "title", "title")) == ["first", "other product", "other rating"]
    again = sampling.dedupe_reviews(kept)
    assert sorted(again.collect()) == sorted(kept.collect())


def test_group_rank_equals_a_window(spark):
    df = spark.range(5000).select(
        F.lit("p").alias("product_id"),
        F.concat(F.lit("play-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).alias("id"),
    )
    ranked = ranking.group_rank(df, KEYS, {"b": ranking.order_buckets(df, "id")}, [F.col("id")])
    ids = [r.id for r in ranked.orderBy("rn").collect()]
    assert ids == sorted(ids) and len(ids) == 5000
    other = df.withColumn("id", F.concat(F.lit("same long prefix "), F.col("id")))
    ranked = ranking.group_rank(other, KEYS, {"b": ranking.order_buckets(other, "id")}, [F.col("id")])
    assert [r.id for r in ranked.orderBy("rn").collect()] == ["same long prefix " + i for i in ids]
    assert ranking.top_ranked(df, KEYS, [F.col("id")], 4000).count() == 4000


def round_robin(rows, n):
    strata = {}
    for id, rating in sorted(rows):
        strata.setdefault(rating, []).append(id)
    order = sorted(strata, key=lambda r: (r is None, r or 0))
    out = []
    while len(out) < n and any(strata.values()):
        for r in order:
            if strata[r] and len(out) < n:
                out.append(strata[r].pop(0))
    return out


@pytest.mark.parametrize("n", [1, 7, 40, 1200, 5000])
def test_stratified_sample_by_brute_force(spark, n):
    rows = [(f"play-{i * 7919 % 65536:04x}{i:012d}", [None, 1.0, 1.0, 1.0, 5.0][i % 5]) for i in range(1500)]
    df = spark.createDataFrame([("p", *r) for r in rows], "product_id string, id string, rating double")
    got = [r.id for r in sampling.stratified_sample(df, n, KEYS).orderBy("pick").collect()]
    assert got == round_robin(rows, n)
    assert sampling.stratified_sample(df, 0, KEYS).count() == 1500


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}, {"max_bytes": 0}])
def test_small_join_has_a_way_beyond_the_bound(spark, limits):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    joined = joins.join_small(big, small, ["k"], **limits)
    assert joined.count() == 67
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().toString()) is (not limits) or limits


def test_candidates_keep_unrated_reviews(spark):
    long = "crash " * 12
    rows = [review("a", long, None), review("b", long, 3.0), review("c", long, 4.0), review("d", "crash " * 11, 1.0)]
    df = reviews(spark, rows).withColumn("theme_id", F.lit("app_reliability"))
    top = themes.rank_themes(themes.theme_counts(df, KEYS), KEYS)
    got = evidence.quote_candidates(df, top, KEYS)
    assert column(got, "id", "candidate_rank") == ["b", "a"]


def test_quotes_prefer_theme_words_then_low_ratings(spark):
    pad = "really truly every single day of this long week for me"
    rows = [
        review("one", f"crash {pad}", 1.0),
        review("two", f"crash crash {pad}", 3.0),
        review("off", f"nothing {pad}", 1.0),
        review("buy", f"buy {pad}", 2.0),
        review("hin", f"crash hai hai hai {pad}", 1.0),
    ]
    df = reviews(spark, rows).withColumn(
        "theme_id", F.when(F.col("id") == "buy", "trading_orders").otherwise("app_reliability")
    )
    top = themes.rank_themes(themes.theme_counts(df, KEYS), KEYS)
    got = evidence.select_quotes(evidence.quote_candidates(df, top, KEYS), KEYS)
    assert column(got, "id", "quote_rank") == ["two", "buy", "one"]


def test_padding_skips_used_ids_and_wordings(spark):
    rows = [review("a", "first words here"), review("b", "first words here", 2.0), review("c", " second "), review("d", "third one", 5.0)]
    df = reviews(spark, rows)
    picked = spark.createDataFrame(
        [("p", 1, "a", "x", 1.0, "first words here")],
        "product_id string, quote_rank int, id string, theme_id string, rating double, quote string",
    )
    got = evidence.pad_quotes(picked, df.withColumn("theme_id", F.lit("x")), df, KEYS)
    assert column(got, "id", "quote_rank") == ["a", "c", "d"]


def test_verbatim_with_and_without_citation(spark):
    df = reviews(spark, GOLDEN)
    quotes = spark.createDataFrame(
        [
            ("p", "play-a", "The app crashes after the latest update…"),
            ("p", "play-a", "I cannot sell my shares"),
            ("p", "play-b", "Users hate the imaginary checkout bug."),
            ("p", "play-b", " “” "),
            ("q", "play-b", "I cannot sell"),
        ],
        "product_id string, id string, quote string",
    )
    got = evidence.verbatim_in_group(quotes, df, KEYS).collect()
    assert {r.quote for r in got if r.verbatim} == {
        "The app crashes after the latest update…",
        "I cannot sell my shares",
    }
    blind = evidence.verbatim_in_group(quotes.drop("id"), df, KEYS)
    assert blind.filter("verbatim").count() == 2


NEEDLES = [
    "crash", "a", "é", "app crash", "he app cr", "the latest update and charts", "nowhere to be found in here",
    "latest update and charts freeze", "sell my shares and the stop-loss never", "zz", "…", "freeze.", "update  and",
    "I cannot sell my shares and the stop-loss never triggers.",
]


def test_uneven_white_space(spark):
    df = reviews(spark, [review("a", "one  two\nthree four")])
    quotes = spark.createDataFrame([("p", "a", "one two three…")], "product_id string, id string, quote string")
    assert not evidence.verbatim_in_group(quotes, df, KEYS).first().verbatim
    assert evidence.verbatim_in_group(quotes, df, KEYS, loose_space=True).first().verbatim


def test_label_payload(spark):
    df = reviews(spark, [review("a", "x" * 400, None)])
    payload = themes.label_payload(df).first().payload
    assert payload == '{"id":"a","rating":null,"text":"' + "x" * 350 + '"}'
    hinted = themes.label_payload(df.withColumn("hint", F.lit("fees_funding"))).first().payload
    assert hinted.endswith('","hint":"fees_funding"}')


def test_corpus_search_by_brute_force(spark):
    texts = [r[5] for r in GOLDEN] + ["", "é", "one two three four five six seven"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    got = {r.needle: r.verbatim for r in evidence.verbatim_in_corpus(needles, corpus).collect()}
    assert got == {n: n != "…" and any(n in t for t in texts) for n in NEEDLES}


def test_picks_need_a_known_review_and_true_words(spark):
    picks = spark.createDataFrame(
        [
            ("p", 1, "play-x", "The app crashes"),
            ("p", 2, "play-a", "made up words"),
            ("p", 3, "play-b", "“Customer support never replies”"),
            ("p", 4, "play-a", "The app crashes"),
        ],
        "product_id string, pick_rank int, id string, quote string",
    )
    got = evidence.resolve_picks(picks, reviews(spark, GOLDEN), KEYS)
    assert column(got, "quote", "quote_rank") == ["Customer support never replies", "The app crashes"]


def test_evidence_views(spark):
    rows = spark.createDataFrame([("p", t) for t in VOCABULARY.ids], "product_id string, theme_id string")
    top = spark.createDataFrame([("p", t) for t in TOP], "product_id string, theme_id string")
    assert evidence.filter_evidence(rows, "all").count() == 5
    assert evidence.filter_evidence(rows, "top3", top, KEYS).count() == 3
    assert evidence.filter_evidence(rows, "top3", top, KEYS, quotes=True).count() == 5
    assert evidence.filter_evidence(rows, "fees_funding").count() == 1


def test_empty_groups_are_padded(spark):
    groups = spark.createDataFrame([("p",)], "product_id string")
    none = themes.rank_themes(
        themes.theme_counts(reviews(spark, []).withColumn("theme_id", F.lit("x")), KEYS), KEYS
    )
    padded = report.pad_themes(none, groups, KEYS)
    assert column(padded, "theme_id", "rank") == VOCABULARY.ids[:3]
    assert padded.first().summary == "Insufficient volume this window"
    actions = report.pad_actions(report.default_actions(none, KEYS), none, groups, KEYS)
    assert column(actions, "theme_id", "action_rank") == VOCABULARY.ids[:3]


def golden_report(spark, quotes=None, words=None):
    quotes = [r[5] for r in GOLDEN] if quotes is None else quotes
    labels = [VOCABULARY.by_id(t).label for t in TOP]
    lines = ["# P Weekly Review — Week Ending 2026-09-08", "", "## Top Themes"]
    lines += [f"{i}. {t}" for i, t in enumerate(labels, 1)] + ["", "## What Users Said"]
    lines += [f"{i}. “{q}”" for i, q in enumerate(quotes, 1)] + ["", "## Action Ideas"]
    lines += [f"{i}. {a}" for i, a in enumerate(ACTIONS, 1)]
    body = "\n".join(lines) + "\n"
    df = spark.createDataFrame(
        [("p", labels, quotes, ACTIONS, body)],
        "product_id string, themes array<string>, quotes array<string>, actions array<string>, body string",
    )
    from voxboard.functions.text import word_count

    return df.withColumn("word_count", word_count(F.col("body")) if words is None else F.lit(words))


def golden_themes(spark):
    rows = [("p", t, VOCABULARY.by_id(t).label, "4 reviews; 2 rated ≤2★") for t in TOP]
    return spark.createDataFrame(rows, "product_id string, theme_id string, label string, summary string")


def outcome(spark, corpus=None, table=None, rep=None):
    checks = gates.evaluate_gates(
        reviews(spark, GOLDEN) if corpus is None else corpus,
        golden_themes(spark) if table is None else table,
        golden_report(spark) if rep is None else rep,
        KEYS,
        as_of=AS_OF,
        weeks=8,
    )
    return {r.name: r for r in checks.collect()}


def test_all_gates_pass_on_a_clean_report(spark):
    got = outcome(spark)
    assert list(got) == gates.GATE_NAMES
    assert all(g.ok and g.errors == [] for g in got.values()), got
    assert got["window"].detail == "2026-09-05 -> 2026-09-05 (3 reviews)"
    assert got["theme_count"].detail == "3 clustered; report top 3"


def test_gates_report_what_is_wrong(spark):
    corpus = reviews(spark, [*GOLDEN, review("x", "old words", ago=200, source="other", language=None)])
    table = golden_themes(spark).union(
        spark.createDataFrame([("p", "kyc", "KYC", "call 9876543210"), ("p", TOP[0], "Wrong", "")], golden_themes(spark).schema)
    )
    bad = golden_report(spark, ["The app crashes after", "made up", "mail a@b.co"], words=5)
    got = outcome(spark, corpus, table, bad)
    assert not any(got[n].ok for n in ("window", "theme_count", "quotes", "length", "privacy", "source"))
    assert got["actions"].ok
    assert got["quotes"].errors == [
        "quote 2 is not a verbatim substring of any review text",
        "quote 3 is not a verbatim substring of any review text",
    ]
    assert got["source"].errors == [
        "1 review(s): source must be 'play'",
        "1 review(s): language must be 'en'",
    ]
    assert got["window"].errors[0].startswith("1 review(s) outside 8-week window ending 2026-09-08")
    assert any("unknown theme id 'kyc'" in e for e in got["theme_count"].errors)
    assert any("duplicate theme id 'app_reliability'" in e for e in got["theme_count"].errors)
    assert any("(phone pattern)" in e for e in got["privacy"].errors)
    assert "report body contains possible PII (email pattern)" in got["privacy"].errors
    messages = gates.source_violations(corpus).collect()
    assert {m.message for m in messages} == {
        "review x: source must be 'play' (got 'other')",
        "review x: language must be 'en' (got None)",
    }


def test_gates_without_reviews(spark):
    got = outcome(spark, corpus=reviews(spark, []))
    assert got["window"].errors == ["no reviews loaded"] and got["window"].detail == "no reviews"
    assert not got["source"].ok and not got["quotes"].ok


def test_window_gate_has_two_days_of_slack(spark):
    for ago, ok in [(58, True), (59, False), (-2, True), (-3, False)]:
        profile = gates.review_profile(reviews(spark, [review("x", "t", ago=ago)]), KEYS, AS_OF, 8)
        row = profile.select(F.inline(F.array(gates.window_gate()))).first()
        assert row.ok is ok, ago


def test_sparse_report_relaxes_counts(spark):
    short = golden_report(spark, ["The app crashes after"]).withColumn("insufficient_signal", F.lit(True))
    assert outcome(spark, rep=short)["quotes"].ok
    assert not outcome(spark, rep=golden_report(spark, ["The app crashes after"]))["quotes"].ok
    warned = gates.sparse_warnings(short).first().warnings
    assert len(warned) == 2 and "Exact 3/3/3 relaxed" in warned[1]


def test_stored_reports(spark):
    stored = golden_report(spark).select("product_id", "body")
    groups = spark.createDataFrame([("p",), ("lost",)], "product_id string")
    checks = gates.evaluate_stored(
        reviews(spark, GOLDEN), golden_themes(spark), stored, groups, KEYS, as_of=AS_OF, weeks=8
    )
    rolled = {r.product_id: r for r in gates.gate_report(checks, KEYS).collect()}
    assert rolled["p"].ok and rolled["p"].n_failed == 0 and len(rolled["p"].gates) == 7
    assert not rolled["lost"].ok and rolled["lost"].errors == ["report not found"]


def test_parse_round_trip(spark):
    row = report.parse_reports(golden_report(spark)).first()
    assert row.parsed_quotes == [r[5] for r in GOLDEN]
    assert row.parsed_themes == [VOCABULARY.by_id(t).label for t in TOP]
    assert row.parsed_actions == ACTIONS
    assert str(row.parsed_week_ending) == "2026-09-08"


def test_long_reports_are_shortened(spark):
    long = " ".join(f"word{i}" for i in range(36))
    themes_ = [("One", 5, 2.5), ("Two", 4, None), ("Three", 3, 1.0)]
    df = spark.createDataFrame(
        [(dt.date(2026, 9, 8), themes_, [long] * 3, [long * 2] * 3, 12, 8)],
        "week_ending date, themes array<struct<label string, review_count long, avg_rating double>>, "
        "quotes array<string>, actions array<string>, review_count long, weeks_used int",
    )
    body = report.compose(df, F.lit("P")).first().body
    assert "(5 reviews" not in body and "word27…" in body and "word28" not in body.split("## Action")[0]
    short = df.withColumn("actions", F.array(*[F.lit("do the right thing now")] * 3))
    body = report.compose(short, F.lit("P")).first().body
    assert "1. One (5 reviews, avg 2.5)\n2. Two (4 reviews, avg None)" in body
    sparse = report.compose_sparse(short, F.lit("P")).first().body
    assert sparse.startswith("# P Weekly Review — Week Ending 2026-09-08\n\n**Insufficient signal:** only 12 Play Store")
    assert sparse.endswith("now\n") and "\n\n## Top Themes" in sparse


RUN = "product_id string, week_key string, validation_ok boolean, insufficient_signal boolean, doc_id string, doc_url string, draft_id string, finished_at timestamp, word_count int, top_3 array<string>, week_ending date"


def run(week, ok=True, sparse=False, doc=None, url=None, draft=None, hour=1):
    return ("p", week, ok, sparse, doc, url, draft, dt.datetime(2026, 9, 9, hour), 200, ["fees_funding"], day(0))


def test_publish_queue(spark):
    runs = spark.createDataFrame(
        [run("W1"), run("W2"), run("W3"), run("W4", ok=False), run("W5", sparse=True), run("W6"), run("W7")], RUN
    )
    prior = spark.createDataFrame(
        [
            run("W1", doc="d", url="u", draft="m"),
            run("W2", doc="d2", url="u2"),
            run("W3", doc="d3"),
            run("W6", ok=False, doc="d", url="u", draft="m"),
            run("W7", doc="d", url="u", draft="m", hour=1),
            run("W7", doc=None, hour=5),
        ],
        RUN,
    )
    week = ["product_id", "week_key"]
    queue = {r.week_key: r for r in ledger.publish_queue(runs, prior, week).collect()}
    assert sorted(queue) == ["W2", "W3", "W6", "W7"]
    assert (queue["W2"].draft_only, queue["W2"].prior_doc_id, queue["W2"].email_mode) == (True, "d2", "link")
    assert (queue["W3"].draft_only, queue["W3"].email_mode) == (True, "full")
    assert not queue["W7"].draft_only
    assert ledger.publish_queue(runs, prior, week, allow_sparse=True).count() == 5
    assert {r.week_key for r in ledger.partial_deliveries(ledger.latest_runs(prior, week)).collect()} == {"W2", "W3"}


def test_fresh_corpus(spark):
    df = spark.createDataFrame([("p", dt.datetime(2026, 9, 8, 8, 0, 0))], "product_id string, ingested_at timestamp")
    assert ledger.require_fresh(df, "2026-09-08 08:00:05", KEYS) is df
    with pytest.raises(ValueError):
        ledger.require_fresh(df, "2026-09-08 08:00:06", KEYS)


def test_label_queue_and_merge(spark):
    rows = [
        review("play-1", "fee", 5.0), review("play-2", "buy support", 4.0), review("play-3", "nothing", None),
        review("play-4", "buy chart", 1.0), review("play-5", "chart fee", 2.0),
    ]
    routed = themes.split_label_queue(reviews(spark, rows), KEYS, max_n=3, batch_size=2)
    got = {r.id: (r.route, r.queue_rank, r.batch, r.theme_id) for r in routed.collect()}
    assert got == {
        "play-1": ("confident", None, None, "fees_funding"),
        "play-4": ("queue", 1, 0, None),
        "play-5": ("queue", 2, 0, None),
        "play-2": ("queue", 3, 1, None),
        "play-3": ("heuristic", None, None, "app_reliability"),
    }
    labels = spark.createDataFrame(
        [("p", "play-4", "customer_support"), ("p", "play-5", "onboarding"), ("p", "play-1", "trading_orders")],
        "product_id string, id string, theme_id string",
    )
    merged = themes.merge_labels(routed, labels, KEYS)
    assert column(merged, "theme_id", "id") == [
        "fees_funding", "trading_orders", "app_reliability", "customer_support", "charts_market_data",
    ]
    batches = themes.batch_tokens(themes.batch_payloads(routed, KEYS), "s" * 8)
    assert column(batches, "n", "batch") == [2, 1]
    assert all(r.tokens == 2 + 400 + -(-len(r.payload) // 4) for r in batches.collect())


def test_scrub_drops_rows_without_text(spark):
    df = reviews(spark, [review("a", "  "), review("b", "mail x@y.org")])
    rows = scrub.scrub(df)
    assert [(r.id, r.text) for r in rows.collect()] == [("b", "mail [email]")]
    assert rows.columns == df.columns
    assert scrub.pii_rows(df).count() == 1


def test_budget_looks_back_sixty_seconds(spark):
    start = dt.datetime(2026, 9, 8, 8, 0, 50)
    rows = [("g", start + dt.timedelta(seconds=s), 1000) for s in (0, 10, 59, 60, 61, 300)]
    df = spark.createDataFrame(rows, "provider string, ts timestamp, tokens int")
    got = rolling_budget(df).orderBy("ts").collect()
    assert [r.requests_60s for r in got] == [1, 2, 3, 4, 4, 1]
    assert [r.tokens_60s for r in got] == [1000, 2000, 3000, 4000, 4000, 1000]
    assert not any(r.over_requests or r.over_tokens for r in got)


def test_ledger_schema_and_kpi_strip(spark):
    assert RUN_SCHEMA.fieldNames()[0] == "product_id"
    df = spark.createDataFrame([(139, False), (10, True)], "word_count int, delivery_skipped boolean")
    rows = metrics.kpi_strip(df).collect()
    assert rows[0].length_display == "139 / 250" and rows[1].delivery == "Local only"
