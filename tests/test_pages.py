"""Character references against Python's, page states, card and top-card fields, prices, payloads of unknown shape, metadata, and the history's attributes."""

import datetime as dt
import html as python_html
import itertools
import json

import pytest
from pyspark.sql import functions as F

from lodestream.functions import entities
from lodestream.operators import listings, reports
from lodestream.sources import boards, html

TEXTS = ["", "&", "&;", "a & b", "&amp;", "&amp;lt;", "&amp;amp;amp;", "&lt;b&gt;", "&mdash;&#8217;&#x2019;&eacute;", "&nbsp;x", "&copy2020", "&notit;", "&notin;", "&bogus;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x110000;", "&#xfffffffffffff;", "&#128512;", "&#x1F600", "&#65", "&#150;", "&#x80;", "&#129;", "&#;", "&#x;", "&am", "&amp", "x&quot", "&frac12;&AMP;&Amp;", "&CounterClockwiseContourIntegral;", "&acE;", "&#00065;"]


def test_references_against_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", entities.decode(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) is None
    assert got == {i: python_html.unescape(t) for i, t in enumerate(TEXTS)}


def test_every_name(spark):
    names = [n for n in python_html.entities.html5 if n.endswith(";")]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["x"] for r in rows.select("n", entities.decode(F.concat(F.lit("&"), "n")).alias("x")).collect()} == {n: python_html.entities.html5[n] for n in names}


def state(spark, board, **over):
    row = dict(requested="https://h.example.com/stu/postings?b=2&a=1", final=None, html="", status=200, cards=0) | over
    df = spark.createDataFrame([tuple(row.values())], "requested string, final string, html string, status int, cards int")
    return df.select(boards.page_state(board, **{c: F.col(c) for c in row}).alias("s")).first()["s"]


HANDSHAKE = [
    (dict(html="Please LOG IN", cards=2), "success", "results"), (dict(html="Please LOG IN"), "auth_blocked", "auth_blocked"), (dict(status=401, html="no results"), "auth_blocked", "auth_blocked"), (dict(final="https://h.example.com/users/sign_in"), "auth_blocked", "auth_blocked"),
    (dict(final="https://h.example.com/other", html="no results"), "upstream_failure", "unexpected_redirect"), (dict(final="https://h.example.com/stu/postings/2"), "layout_mismatch", "selector_mismatch"), (dict(html="<p>0 jobs</p>"), "empty_success", "empty_results"),
    (dict(requested="https://h.example.com/x", html="nothing"), "empty_success", "no_cards_found"), (dict(requested="https://h.example.com/x", html="filters"), "layout_mismatch", "selector_mismatch"), (dict(final="HTTPS://H.example.com/stu/postings/?a=1&b=2#f"), "layout_mismatch", "selector_mismatch"),
]
GLASSDOOR = [
    (dict(status=429, html="accept all cookies"), "anti_bot_blocked", "anti_bot_detected"), (dict(final="https://h.example.com/captcha/x"), "anti_bot_blocked", "anti_bot_detected"), (dict(html="Accept all cookies. Sign in"), "consent_blocked", "consent_wall_detected"), (dict(html="Sign in, 0 jobs"), "auth_blocked", "login_wall_detected"),
    (dict(final="https://h.example.com/other"), "upstream_failure", "unexpected_redirect"), (dict(final="https://www.glassdoor.com/partner/jobListing.htm"), "layout_mismatch", "layout_mismatch"), (dict(html="No jobs to display"), "empty_success", "true_empty_results"), (dict(html=None), "layout_mismatch", "layout_mismatch"), (dict(cards=1, status=403), "success", "results"),
]


@pytest.mark.parametrize(("board", "cases"), [("handshake", HANDSHAKE), ("glassdoor", GLASSDOOR)])
def test_page_states(spark, board, cases):
    for over, status, page in cases:
        s = state(spark, board, **over)
        assert (s["source_status"], s["page_state"]) == (status, page), over


def test_page_signals(spark):
    s = state(spark, "handshake", final="https://h.example.com/login", status=403, html="")
    assert s["login_wall"] and s["auth_required"] and s["redirect"] and not s["layout"] and not s["empty"]
    s = state(spark, "handshake", status=403)
    assert not s["login_wall"] and s["auth_required"]
    s = state(spark, "glassdoor", html="captcha jobcard", cards=0)
    assert s["anti_bot"] and not s["layout"] and "auth_required" not in s.asDict()


def test_card_fields(spark):
    card = '<b class="base-search-card__subtitle"><i> </i></b><b class="job-search-card__subtitle">Halden &amp; Co</b> location: Oslo, NO <time datetime="2026-03-01">x</time>'
    rows = [("LinkedIn", card), ("indeed", card), ("other", "<p>Employer: Halden Works</p><p>posted 3 days ago</p>"), ("handshake", None)]
    got = [tuple(r["f"]) for r in spark.createDataFrame(rows, "b string, h string").select(boards.card_fields(F.col("b"), F.col("h")).alias("f")).collect()]
    assert got[0] == ("Halden & Co", "Oslo, NO x", "2026-03-01", "Halden & Co location: Oslo, NO x")
    assert got[1][0] is None and got[2][0] == "Halden Works posted 3 days ago" and got[2][2] == "3 days ago"
    assert got[3] == (None, None, None, None)


def test_top_cards(spark):
    box = '<div class="job-details-jobs-unified-top-card__primary-description-container">{}</div>'
    rows = [("Kiln Keeper", box.format("Kiln keeper · Remote today · Oslo, NO · Halden · over 9 applicants")), ("x", box.format("3+ days ago • 2 weeks ago &middot; Halden") + '<a class="topcard__org-name-link">Named</a>'), ("x", ""), ("x", None)]
    got = [tuple(r["c"])[:4] for r in spark.createDataFrame(rows, "t string, h string").select(boards.top_card(F.col("h"), F.col("t")).alias("c")).collect()]
    # the token that is a date is no place, though it speaks of one
    assert got == [("Halden", "Oslo, NO", "Remote today", 0), ("Named", None, "3+ days ago", 3), (None, None, None, None), (None, None, None, None)]


PAGE = '{"price": {"customerPrice": 5.5, "displayableRegularPrice": 9, "skuId": "12345"}} "price":{"customerPrice":7,"displayableRegularPrice":8,"skuId":"12345"} Card 12\\" X {"customerPrice": 3, "displayableRegularPrice": 2}'


def test_prices_of_an_offer(spark):
    rows = [("was $20 now $10", "Z", "12345"), ("was $20 now $10", "Z", "99999"), ("nothing", 'Card 12" X', None), ("nothing", "never there", None), ("$3 and $1,000.00", "Z", None), ("was $5 now $10", "Z", None), (None, "Z", None)]
    df = spark.createDataFrame([(PAGE, *r) for r in rows], "h string, s string, t string, k string")
    got = [tuple(r["p"]) for r in df.select(html.offer_prices(F.col("h"), F.col("s"), F.col("t"), F.col("k"), "bestbuy").alias("p")).collect()]
    assert got == [(7.0, 8.0), (10.0, 20.0), (3.0, 8.0), (None, None), (3.0, 1000.0), (10.0, None), (None, None)]
    assert dict(spark.createDataFrame([(PAGE,)], "h string").select(html.offered_skus(F.col("h"), "regular").alias("m")).first()["m"]) == {"12345": 8.0}


def test_payloads_of_unknown_shape(spark):
    rows = ['[{"k":1},2,"x",null,{"k":2}]', '{"results":[{"k":1}],"deals":[{"k":0},5],"items":"none"}', '{"price":null}', '{"k":1}', '{"items":[],"title":"t"}', "5", "not json", "", None, "[]"]
    got = [[json.loads(x) for x in r["i"]] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(html.raw_items(F.col("p")).alias("i")).collect()]
    assert got == [[{"k": 1}, {"k": 2}], [{"k": 0}, {"k": 1}], [{"price": None}], [], [{"items": [], "title": "t"}], [], [], [], [], []]


def test_metadata(spark):
    rows = ['{"a":[1,null]}', "plain text", '"quoted"', " ", None, "7"]
    df = spark.createDataFrame([(x,) for x in rows], "m string").select(reports.metadata_of(F.col("m")).alias("v"), reports.metadata_of(F.col("m"), keep_bad=False).alias("s"))
    got = df.select(reports.metadata_text(F.col("v")).alias("a"), reports.metadata_text(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in got] == [('{"a":[1,null]}',) * 2, ("plain text", None), ("quoted", "quoted"), (None, None), (None, None), ("7", "7")]


BATCHES = {
    "b1": [("k", 1, 0, 0, 1, "Old", None, "s1", "u1"), ("k", 1, 1, 0, 2, " ", "C2", None, None), ("", 1, 0, 0, 9, "no key", None, None, None)],
    "b2": [("k", 1, 0, 1, 5, "New", "", "s5", None), ("j", 1, 0, 0, 3, None, None, None, None)],
    "b3": [("k", 1, 1, 0, 3, "Mid", "C3", "s3", "u3"), ("k", 1, 0, 0, 5, "Nex", None, None, None)],
}


def test_history_is_the_same_in_any_order_and_however_often(spark, tmp_path):
    kinds = "job_key string, seen long, shortlisted long, notified long, at timestamp, title string, company string, source string, url string"
    day = lambda n: dt.datetime(2026, 3, n)
    frames = {b: spark.createDataFrame([(*r[:4], day(r[4]), *r[5:]) for r in rows], kinds) for b, rows in BATCHES.items()}
    results = []
    for n, order in enumerate([("b1", "b2", "b3"), ("b3", "b1", "b2", "b1"), ("b2", "b2", "b3", "b1", "b3")]):
        done = [listings.apply_batch(spark, f"{tmp_path}/{n}", frames[b], b) for b in order]
        assert sum(done) == 3
        results.append(sorted(map(tuple, listings.history_view(listings.read_history(spark, f"{tmp_path}/{n}")).collect())))
    assert results[0] == results[1] == results[2]
    assert results[0] == [("j", 1, 0, 0, day(3), day(3), None, None, None, None, None, None), ("k", 5, 2, 1, day(1), day(5), day(3), day(5), "Nex", "C3", "s5", "u3")]


def test_merging_attributes_is_free_of_order(spark):
    kinds = "job_key string, seen long, shortlisted long, notified long, at timestamp, title string, company string, source string, url string"
    frames = [spark.createDataFrame([(*r[:4], dt.datetime(2026, 3, r[4]), *r[5:]) for r in rows], kinds) for rows in BATCHES.values()]
    none = spark.createDataFrame([], listings.history_schema())
    seen = set()
    for order in itertools.permutations(frames, 2):
        h = none
        for f in order:
            h = listings.history_merge(h, f)
        seen.add((frames.index(order[0]) + frames.index(order[1]), str(sorted(map(str, h.collect())))))
    assert len(seen) == 3
