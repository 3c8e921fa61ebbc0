"""Rows out of captured HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities, text, urls

ANCHOR = re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", re.I | re.S)
#: White space of any kind: references may stand for some that \s doesn't fit.
SPACES = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(html: Column) -> Column:
    """Visible text: tags out, character references decoded, white space squeezed."""
    return F.trim(F.regexp_replace(entities.decode(F.regexp_replace(html, r"<[^>]+>", " ")), SPACES, " "))


def anchors(pages: DataFrame, *, before: int = 900, after: int = 2000) -> DataFrame:
    """(page_id, pos, href, label, url, snippet): every link of a page, in order, resolved against the page's url, with the text around it.

    The places of matches are needed for the snippets, which no built-in function gives; all else stays in Catalyst.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "base", "pos", "href", "label_html", "snippet"]
        for b in batches:
            for page, base, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                rows = [(page, base, i, m[1], m[2], html[max(0, m.start() - before) : m.start() + after]) for i, m in enumerate(ANCHOR.finditer(html or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    found = pages.select("page_id", "url", "html").mapInArrow(find, "page_id long, base string, pos int, href string, label_html string, snippet string")
    return found.select("page_id", "pos", "href", strip(F.col("label_html")).alias("label"), urls.absolute_url(F.col("base"), F.col("href")).alias("url"), "snippet")


def job_cards(pages: DataFrame, pattern: str) -> DataFrame:
    """Links whose address fits pattern and whose label has four characters or more, each address once per page."""
    good = anchors(pages).filter(F.col("url").rlike(pattern) & (F.length("label") >= 4))
    return good.groupBy("page_id", "url").agg(F.min_by(F.struct("pos", "label", "snippet"), "pos").alias("f")).select("page_id", "url", "f.*")


def product_deals(pages: DataFrame, keyword: str, *, most: int = 40) -> DataFrame:
    """The first `most` links of a page whose label holds the keyword, with prices from the text around them."""
    hit = anchors(pages, before=700, after=1400).filter(F.lower("label").contains(keyword.lower()))
    prices = text.price_values(F.col("snippet"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    first = hit.withColumn("_n", n).filter(F.col("_n") <= most).withColumns({"price": F.array_min(prices), "top": F.array_max(prices)})
    return first.select("page_id", "pos", F.col("label").alias("title"), "url", "price", F.when(F.col("top") > F.col("price"), F.col("top")).alias("old_price"), text.stock(F.col("snippet")).alias("in_stock"))


def first_match(html: Column, patterns: tuple[str, ...]) -> Column:
    """The first non-empty group 1 of an ordered list of patterns."""
    return F.coalesce(*[text.as_text(strip(F.regexp_extract(html, p, 1))) for p in patterns])


def card_tokens(html: Column) -> Column:
    """The distinct parts of a text split at middle dots and bullets, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(strip(html), "[·•]"), lambda t: F.trim(t)), lambda t: t != ""))


def link_count(html: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))))


# How shops write prices, and the JSON inside their pages. A shop has patterns for the price now, tried in order, one for the price before, and what counts if none is found.
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]{2})?)"
SHOPS = {
    "bestbuy": {"now": (rf"(?i)(?:now|sale|current|price)\D{{0,20}}\${AMOUNT}",), "before": rf"(?i)(?:was|regular|orig(?:inal)?|list)\D{{0,20}}\${AMOUNT}", "else": "least"},
    "newegg": {"now": (rf"(?i)(?:now|sale|current)\D{{0,20}}\${AMOUNT}",), "before": rf"(?i)(?:was|regular|orig(?:inal)?|list|before)\D{{0,30}}\${AMOUNT}", "else": "plausible"},
    "microcenter": {
        "now": (rf"(?i)(?:now|sale|current|price|our price)\D{{0,20}}\${AMOUNT}", r'(?i)data-price="([0-9][0-9,]*(?:\.[0-9]{1,2})?)"', rf'(?is)itemprop="price"[^>]*>\s*(?:<[^>]+>\s*)*\$?\s*{AMOUNT}'),
        "before": rf"(?i)(?:was|regular|orig(?:inal)?|list)\D{{0,20}}\${AMOUNT}", "else": "least",
    },
}
SKU_PRICE = {"customer": r'(?is)"price"\s*:\s*\{.*?"customerPrice"\s*:\s*([0-9]+(?:\.[0-9]+)?).*?"skuId"\s*:\s*"([0-9]{5,})"', "regular": r'(?is)"price"\s*:\s*\{.*?"displayableRegularPrice"\s*:\s*([0-9]+(?:\.[0-9]+)?).*?"skuId"\s*:\s*"([0-9]{5,})"'}
NEAR_PRICE = {"customer": r'(?i)"customerPrice"\s*:\s*([0-9]+(?:\.[0-9]+)?)', "regular": r'(?i)"displayableRegularPrice"\s*:\s*([0-9]+(?:\.[0-9]+)?)'}
BEFORE_TITLE, AFTER_TITLE = 3500, 9000


def price_pair(snippet: Column, shop: str) -> Column:
    """struct(price, old_price) of the text around an offer: the shop's patterns first, then all $ amounts; an old price that isn't above the price is none."""
    return text.let(text.price_values(snippet), lambda amounts: pair_of(snippet, amounts, shop))


def pair_of(snippet: Column, amounts: Column, shop: str) -> Column:
    """price_pair where the $ amounts are known."""
    rules = SHOPS[shop]
    number = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(snippet, p, 1), F.lit("")), ",", "").try_cast("double")
    otherwise = F.array_min(amounts) if rules["else"] == "least" else text.plausible_price(amounts, F.lit(None).cast("string"))

    def pair(x: Column) -> Column:
        old = F.coalesce(x["old"], F.when((F.size(amounts) >= 2) & (F.array_max(amounts) > x["price"]), F.array_max(amounts)))
        return F.struct(x["price"].alias("price"), F.when(x["price"].isNull() | (old > x["price"]), old).alias("old_price"))

    return text.let(F.struct(F.coalesce(*map(number, rules["now"]), otherwise).alias("price"), number(rules["before"]).alias("old")), pair)


def last_prices(skus: Column, prices: Column) -> Column:
    """Map of sku to price from two arrays; of a sku that occurs again the last price counts."""
    pairs = F.zip_with(skus, prices, lambda k, v: F.struct(k.alias("k"), v.cast("double").alias("v")))
    last = lambda ps: F.filter(ps, lambda x, i: ~F.exists(F.slice(ps, i + 2, F.size(ps) + 1), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(text.let(pairs, last))


def sku_prices(html: Column) -> Column:
    """Map of sku to the last customer price of flat JSON inside a page."""
    skus, prices = (F.regexp_extract_all(html, F.lit(r'"sku"\s*:\s*"?([A-Za-z0-9-]+)"?\s*,\s*"customerPrice"\s*:\s*([0-9.]+)'), F.lit(i)) for i in (1, 2))
    return last_prices(skus, prices)


def offered_skus(html: Column, kind: str = "customer") -> Column:
    """Map of sku to the last customer or regular price of a page's offers, whose JSON has the price in an object before the sku."""
    prices, skus = (F.regexp_extract_all(html, F.lit(SKU_PRICE[kind]), F.lit(i)) for i in (1, 2))
    return last_prices(skus, prices)


def title_prices(html: Column, title: Column) -> Column:
    """struct(price, old_price) near the title's first place in a page, where it stands as it is or else with quotes escaped: the least customer price, and the least regular one that isn't below it."""

    def of(at: Column) -> Column:
        start = F.greatest(at - BEFORE_TITLE, F.lit(1))
        values = lambda near: F.struct(*[F.transform(F.regexp_extract_all(near, F.lit(p), F.lit(1)), lambda x: x.cast("double")).alias(k) for k, p in NEAR_PRICE.items()])
        least = lambda v: text.let(F.array_min(v["customer"]), lambda price: F.struct(price.alias("price"), F.array_min(F.filter(v["regular"], lambda r: price.isNull() | (r >= price))).alias("old_price")))
        return F.when((at > 0) & (title != ""), text.let(text.let(F.substring(html, start, at + AFTER_TITLE - start), values), least))

    return text.let(F.coalesce(F.nullif(F.instr(html, title), F.lit(0)), F.instr(html, F.replace(title, F.lit('"'), F.lit('\\"')))), of)


def offer_prices(html: Column, snippet: Column, title: Column, sku: Column, shop: str) -> Column:
    """struct(price, old_price) of an offer: from the text around it, overridden by the page's JSON for its sku, and by prices near its title as the last resort."""
    pair = price_pair(snippet, shop)

    def mapped(p: Column) -> Column:
        given = F.struct(F.coalesce(F.try_element_at(offered_skus(html), sku), p["price"]).alias("price"), F.try_element_at(offered_skus(html, "regular"), sku).alias("regular"))
        return text.let(given, lambda g: F.struct(g["price"].alias("price"), F.when(g["regular"] > g["price"], g["regular"]).otherwise(p["old_price"]).alias("old_price")))

    def hinted(p: Column) -> Column:
        of = lambda near: F.struct(near["price"].alias("price"), F.when(near["old_price"] > near["price"], near["old_price"]).otherwise(p["old_price"]).alias("old_price"))
        return F.when(p["price"].isNotNull(), p).otherwise(text.let(title_prices(html, title), of))

    return text.let(text.let(pair, mapped), hinted)


#: Keys that hold item lists, and keys of which one makes an object an item itself.
LISTS = ("deals", "items", "results", "top_deals", "highest_risk")
ITEM_KEYS = ("title", "name", "url", "link", "price", "old_price", "discount_pct", "score")


def raw_items(payload: Column) -> Column:
    """Items of a JSON payload of unknown shape, as an array of JSON texts: the objects of a list, those of an object's item lists one after the other, or the object itself if it has a key of an item. Anything else has none."""
    parsed = F.try_parse_json(payload)
    objects = lambda items: F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.to_json(x)), lambda x: x.startswith("{"))
    lists = lambda v: F.flatten(F.array(*[objects(F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in LISTS]))
    own = lambda v: F.coalesce(*[F.when(F.variant_get(v, f"$.{k}", "variant").isNotNull(), True) for k in ITEM_KEYS], F.lit(False)) & F.to_json(v).startswith("{")
    none = F.array().cast("array<string>")
    return F.when(parsed.isNull(), none).when(F.schema_of_variant(parsed).startswith("ARRAY"), objects(F.try_variant_get(parsed, "$", "array<variant>"))).when(F.size(lists(parsed)) > 0, lists(parsed)).when(own(parsed), F.array(F.to_json(parsed))).otherwise(none)
