"""Queries over captured pages."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import functions as F

from ..functions import entities
from ..sources import boards, html
from . import inputs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NAMES = "map_from_entries([" + ", ".join(f"({quoted(n)}, chr({c}))" for n, c in name2codepoint.items()) + "])"
_BARE = "map_from_entries([" + ", ".join(f"({quoted(n)}, chr({ord(html5[n])}))" for n in entities.BARE) + "])"
_REFERENCE = rf"""CASE WHEN regexp_matches(r, '^#[0-9]+;?') THEN chr(regexp_extract(r, '^#([0-9]+)', 1)::INT) || regexp_replace(r, '^#[0-9]+;?', '') WHEN regexp_matches(r, '^#[xX][0-9a-fA-F]+;?') THEN chr(('0x' || regexp_extract(r, '^#[xX]([0-9a-fA-F]+)', 1))::INT) || regexp_replace(r, '^#[xX][0-9a-fA-F]+;?', '')
 WHEN {_NAMES}[regexp_extract(r, '^([A-Za-z][A-Za-z0-9]*);', 1)] IS NOT NULL THEN {_NAMES}[regexp_extract(r, '^([A-Za-z][A-Za-z0-9]*);', 1)] || regexp_replace(r, '^[A-Za-z0-9]+;', '') WHEN regexp_matches(r, '^({"|".join(entities.BARE)})') THEN {_BARE}[regexp_extract(r, '^({"|".join(entities.BARE)})', 1)] || regexp_replace(r, '^({"|".join(entities.BARE)})', '') ELSE '&' || r END"""


def decoded(x: str) -> str:
    """References decoded, as far as the names of HTML 4 go."""
    parts = f"string_split({x}, '&')"
    return f"CASE WHEN contains({x}, '&') THEN {parts}[1] || array_to_string(list_transform({parts}[2:], lambda r: {_REFERENCE}), '') ELSE {x} END"


_SPACES = r"[ \t\n\x0b\f\r\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def stripped(x: str) -> str:
    without = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({decoded(without)}, '{_SPACES}', ' ', 'g'))"


HREFS = r"""regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)"""


@query("html_strip", f"SELECT page_id, {stripped('html')} AS visible FROM pages")
def html_strip(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.strip(F.col("html")).alias("visible"))


@query("link_counts", f"SELECT page_id, len(list_distinct({HREFS}))::INTEGER AS links FROM pages")
def link_counts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.link_count(F.col("html")).alias("links"))


REFERENCES = "'<b>x</b> &mdash; &#8217;&#x2019; &eacute;&nbsp;&amp;lt; &notit &copy2 &bogus; &amp;#39; &' || CASE page_id % 4 WHEN 0 THEN '&euro;' WHEN 1 THEN '&#128512;' WHEN 2 THEN '&quot' ELSE '&;' END || html"


@query("html_references", f"SELECT page_id, {stripped('h')} AS visible FROM (SELECT page_id, {REFERENCES} AS h FROM pages)")
def html_references(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.strip(F.expr(REFERENCES)).alias("visible"))


CAPTURED = """SELECT page_id, url AS requested, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://host.example.com/users/sign_in?next=1' WHEN 2 THEN 'https://other.example.com/landing' WHEN 3 THEN 'https://host.example.com/stu/postings?page=2' WHEN 4 THEN 'https://www.glassdoor.com/partner/jobListing.htm?x=1' ELSE url || '#top' END AS final,
 CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN NULL ELSE 200 END AS status, CASE WHEN page_id % 4 = 0 THEN 3 ELSE 0 END AS cards,
 html || CASE page_id % 11 WHEN 0 THEN ' No Results here' WHEN 1 THEN 'Please log in' WHEN 2 THEN 'verify you are human' WHEN 3 THEN 'Accept all cookies' WHEN 4 THEN 'more filters' WHEN 5 THEN 'search results' WHEN 6 THEN 'We couldnt find any jobs' WHEN 7 THEN '0 jobs' WHEN 8 THEN 'jobcard' ELSE '' END AS html FROM pages"""
_PARTS = "lower(regexp_extract({0}, '^([A-Za-z]+)://', 1)) || '|' || lower(regexp_extract({0}, '://([^/?#]*)', 1)) || '|' || regexp_replace(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/+$', '') || '|' || array_to_string(list_sort(list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&')"
_PATH = "lower(regexp_extract({}, '://[^/?#]*([^?#]*)', 1))"


def _states(board: str) -> str:
    rules = boards.PAGE_RULES[board]
    marked = lambda url, name: "(" + " OR ".join(["false", *[f"contains({_PATH.format(url)}, {quoted(m)})" for m in rules["marks"].get(name, ())]]) + ")"
    coded = lambda name: f"coalesce(status IN {rules['status'][name]}, false)" if name in rules["status"] else "false"
    signal = lambda name: "(" + " OR ".join(f"regexp_matches(html, {quoted('(?i)' + p)})" for p in rules["signals"][name]) + f") OR {marked('last', name)} OR {coded(name)}"
    names = [n for n in rules["signals"] if n != "context"]
    listing = " OR ".join(f"regexp_matches(last, {quoted('(?i)' + p)})" for p in boards.JOB_URLS[board]) if board == "glassdoor" else "false"
    flags = ", ".join(f"{signal(n)} AS {n}" for n in names) + f", {signal('context')} OR {marked('requested', 'search')} AS context, {_PARTS.format('last')} <> {_PARTS.format('requested')} AND NOT {marked('last', 'search')} AND NOT ({listing}) AS redirect"
    auth = f", login_wall OR {coded('auth_required')} AS auth_required" if board == "handshake" else ""
    barred = "auth_required" if board == "handshake" else "(anti_bot OR consent_wall OR login_wall)"
    layout = f"(cards = 0 AND NOT empty AND NOT {barred} AND context)"
    pick = lambda i: "CASE WHEN cards > 0 THEN " + quoted(("success", "results")[i - 1]) + " ".join([""] + [f"WHEN {layout if r[0] == 'layout' else 'true' if r[0] is None else r[0]} THEN {quoted(r[i])}" for r in rules["states"]]) + " END"
    mismatch = layout if board == "handshake" else f"{pick(1)} = 'layout_mismatch'"
    shown = [*names, "redirect"] + (["auth_required"] if board == "handshake" else [])
    return f"SELECT page_id, {pick(1)} AS source_status, {pick(2)} AS page_state, {', '.join(shown)}, {mismatch} AS layout FROM (SELECT *{auth} FROM (SELECT *, {flags} FROM (SELECT *, coalesce(nullif(trim(final), ''), requested) AS last FROM ({CAPTURED}))))"


def _states_of(spark, sf_dir, board):
    rows = spark.sql(CAPTURED.replace("FROM pages", "FROM {pages}"), pages=pages(spark, sf_dir))
    state = boards.page_state(board, requested=F.col("requested"), final=F.col("final"), html=F.col("html"), status=F.col("status"), cards=F.col("cards"))
    return rows.select("page_id", state.alias("s")).select("page_id", "s.*")


@query("page_states_handshake", _states("handshake"))
def page_states_handshake(spark, sf_dir):
    return _states_of(spark, sf_dir, "handshake")


@query("page_states_glassdoor", _states("glassdoor"))
def page_states_glassdoor(spark, sf_dir):
    return _states_of(spark, sf_dir, "glassdoor")


#: Cards made of a page's heading: a board's marks in some, hints in plain text in others.
CARDS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'Indeed' WHEN 2 THEN 'glassdoor' WHEN 3 THEN 'handshake' ELSE 'other' END AS board, CASE page_id % 4 WHEN 3 THEN NULL ELSE '<div>' || h || ' Company: Halden ' || page_id || ' & Co</div><p>Location - Oslo ' || page_id || ' 3 days ago</p>' || CASE WHEN page_id % 2 = 0 THEN
 '<h4 class="base-search-card__subtitle"> </h4><a class="job-search-card__subtitle x">' || h || ' &amp; Sons</a><i class="job-search-card__location"><b>Bergen, NO</b></i><time class="t" datetime="2026-03-0' || page_id % 9 || '">1 week ago</time><p class="job-search-card__snippet">snip ' || h || '</p><span data-testid="company-name">' || h || '</span><span class="companyLocation"> Remote </span><em data-testid="date">today</em><ul class="job-snippet"><li>do things</ul><b class="EmployerProfile">' || h || '</b><u data-test="location">Oslo</u><s data-test="detailText">30d+</s><q class="jobDescriptionSnippet">text</q><b class="employer">Emp</b><b class="posted">yesterday</b><b class="description">' || repeat(h || ' ', 40) || '</b>' ELSE '' END END AS html
 FROM (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM {pages})"""


def _field(k: str) -> str:
    plain = stripped("coalesce(html, '')")
    squeezed = lambda x: rf"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')".replace("\\\\", "\\")
    tried = lambda b: "coalesce(" + ", ".join([*[squeezed(stripped(f"regexp_extract(html, {quoted('(?is)' + p)}, 1)")) for p in boards.FIELDS[b][k]], "NULL"]) + ")"
    by = "CASE lower(board) " + " ".join(f"WHEN '{b}' THEN {tried(b)}" for b in boards.FIELDS) + " END"
    return f"nullif(substr(coalesce({by}, {plain}), 1, 500), '')" if k == "description" else f"coalesce({by}, {squeezed(f'regexp_extract({plain}, {quoted(boards.HINTS[k])}, 1)')})"


@query("card_fields", "SELECT page_id, board, " + ", ".join(f"{_field(k)} AS {k}" for k in ("company", "location", "posted", "description")) + f" FROM ({CARDS.replace('{pages}', 'pages')})")
def card_fields(spark, sf_dir):
    rows = spark.sql(CARDS, pages=pages(spark, sf_dir))
    return rows.select("page_id", "board", boards.card_fields(F.col("board"), F.col("html")).alias("f")).select("page_id", "board", "f.*")


TOP_CARDS = """SELECT page_id, h AS title, '<div class="job-details-jobs-unified-top-card__primary-description-container"><span>' || CASE page_id % 5 WHEN 0 THEN h || ' · ' WHEN 1 THEN 'Oslo, NO · ' ELSE '' END || CASE page_id % 3 WHEN 0 THEN 'Reposted 2 weeks ago &middot; ' WHEN 1 THEN '3+ days ago • ' ELSE '' END || 'Halden ' || page_id || ' Works · over 100 applicants · United Kingdom</span></div>'
 || CASE page_id % 4 WHEN 0 THEN '<a class="topcard__org-name-link">Named &amp; Co</a>' ELSE '' END || '<span class="tvm__text--low-emphasis">Promoted · Remote</span><p class="text-body-small">an hour ago · United Kingdom</p>' AS html FROM (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM {pages})"""
_TOKENS = "list_filter(list_transform(flatten(list_transform(flatten([" + ", ".join(f"regexp_extract_all(html, {quoted('(?is)' + p)}, 1)" for p in boards.TOP_TEXTS) + f"]), lambda t: string_split_regex({stripped('t')}, '[·•]'))), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '')"
_LOW = r"regexp_replace(lower({0}), '^\s*reposted\s+', '')"
_AMOUNT = f"coalesce(try_cast(regexp_extract({_LOW}, {quoted(boards.AGE_AMOUNT)}, 1) AS BIGINT), 1)"
_UNIT = f"regexp_extract({_LOW}, {quoted(boards.AGE_AMOUNT)}, 2)"
_AGE = rf"""(CASE WHEN regexp_matches({_LOW}, '\b(today|just posted)\b') THEN 0 WHEN regexp_matches({_LOW}, '\byesterday\b') THEN 1 WHEN regexp_matches({_LOW}, {quoted(boards.AGE_PLUS)}) THEN regexp_extract({_LOW}, {quoted(boards.AGE_PLUS)}, 1)::BIGINT
 WHEN regexp_matches({_LOW}, {quoted(boards.AGE_AMOUNT)}) THEN CASE WHEN regexp_matches({_UNIT}, '^(min|h)') THEN 0 WHEN starts_with({_UNIT}, 'w') THEN {_AMOUNT} * 7 WHEN starts_with({_UNIT}, 'mo') THEN {_AMOUNT} * 30 ELSE {_AMOUNT} END END)"""
_WORD = r"[^\p{L}\p{N}_]"
# DuckDB's word ends know ASCII letters only
_NOISE, _PLACED = (f"regexp_matches(t, {quoted(p.replace(r'(?i)' + chr(92) + 'b(', f'(?i)(?:^|{_WORD})(').replace(chr(92) + 'b)' + chr(92) + 'b', f'(?:{_WORD}|$))').replace(')' + chr(92) + 'b', f')(?:{_WORD}|$)'))})" for p in (boards.TOP_NOISE, boards.TOP_PLACE))
_AGED = _AGE.format("t")


@query("top_cards", rf"""WITH k AS (SELECT page_id, title, html, {_TOKENS} AS every FROM ({TOP_CARDS.replace('{pages}', 'pages')})), d AS (SELECT *, list_filter(every, lambda t, i: list_position(every, t) = i) AS tokens FROM k), p AS (SELECT *, list_filter(tokens, lambda t: {_AGED} IS NOT NULL)[1] AS posted FROM d)
SELECT page_id, coalesce({", ".join(f"nullif({stripped(f'regexp_extract(html, {quoted("(?is)" + x)}, 1)')}, '')" for x in boards.TOP_COMPANY)}, list_filter(tokens, lambda t: length(t) >= 2 AND lower(t) <> lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AND NOT {_NOISE} AND {_AGED} IS NULL AND NOT {_PLACED} AND regexp_matches(t, '\p{{L}}'))[1]) AS company,
 list_filter(tokens, lambda t: NOT {_NOISE} AND {_PLACED} AND t IS DISTINCT FROM posted)[1] AS location, posted, {_AGE.format('posted')}::BIGINT AS age_days, array_to_string(tokens, '|') AS tokens FROM p""")
def top_cards(spark, sf_dir):
    rows = spark.sql(TOP_CARDS, pages=pages(spark, sf_dir))
    return rows.select("page_id", boards.top_card(F.col("html"), F.col("title")).alias("c")).select("page_id", "c.*").withColumn("tokens", F.array_join("tokens", "|"))


@query("page_links", rf"""SELECT page_id, (i - 1)::INTEGER AS pos, href, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href AS url FROM (SELECT page_id, url, generate_subscripts(h, 1) AS i, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h FROM pages))""")
def page_links(spark, sf_dir):
    return html.anchors(pages(spark, sf_dir)).select("page_id", "pos", "href", "url")


@query("job_cards")
def job_cards(spark, sf_dir):
    return html.job_cards(pages(spark, sf_dir), r"/[A-Za-z]{4,}").select("page_id", "pos", "url", "label", F.length("snippet").alias("snippet_chars"))


@query("product_deals")
def product_deals(spark, sf_dir):
    return html.product_deals(pages(spark, sf_dir), "th")


@query("page_titles", rf"""SELECT page_id, nullif({stripped("coalesce(nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), ''), regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")}, '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.first_match(F.col("html"), (r"(?s)<h1>(.*?)</h1>", r"(?s)<title>(.*?)</title>")).alias("title"))


PAYLOADS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '[' || props || ',2,' || props || ',"x"]' WHEN 1 THEN '{{"deals":[' || props || '],"note":1,"results":[' || props || ',null,' || props || '],"items":3}}' WHEN 2 THEN '{{"title":"t","k":1}}' WHEN 3 THEN props WHEN 4 THEN 'not json ' || props WHEN 5 THEN '{{"items":[],"price":null}}' ELSE NULL END AS payload FROM {events}"""


@query("raw_items", """WITH p AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM (__PAYLOADS__)), l AS (SELECT *, list_filter(CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN flatten([coalesce(json_extract(j, '$.deals[*]'), []), coalesce(json_extract(j, '$.items[*]'), []), coalesce(json_extract(j, '$.results[*]'), []), coalesce(json_extract(j, '$.top_deals[*]'), []), coalesce(json_extract(j, '$.highest_risk[*]'), [])]) ELSE [] END, lambda x: json_type(x) = 'OBJECT') AS items FROM p),
 i AS (SELECT event_id, CASE WHEN len(items) > 0 OR json_type(j) IS DISTINCT FROM 'OBJECT' THEN items WHEN len(list_intersect(json_keys(j), ['title', 'name', 'url', 'link', 'price', 'old_price', 'discount_pct', 'score'])) > 0 THEN [j] ELSE [] END AS items FROM l)
 SELECT event_id, (generate_subscripts(items, 1) - 1)::INTEGER AS pos, json_extract_string(unnest(items), '$.k') AS k FROM i""".replace("__PAYLOADS__", PAYLOADS.format(events="events")))
def raw_items(spark, sf_dir):
    rows = spark.sql(PAYLOADS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.select("event_id", F.posexplode(html.raw_items(F.col("payload"))).alias("pos", "item")).select("event_id", "pos", F.get_json_object("item", "$.k").alias("k"))
