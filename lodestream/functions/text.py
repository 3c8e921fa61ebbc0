"""Text, number and label expressions for listings and deals: Column to Column, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of listings.
UNKNOWN_COMPANIES = ("unknown", "unknown company", "unknown employer", "unknown organization", "not provided", "not listed", "n a", "na", "none")
TITLE_ALIASES = {"sr": "senior", "jr": "junior", "eng": "engineer", "dev": "developer"}
TITLE_STOPWORDS = ("the", "a", "an", "for", "of", "to", "and", "with")
ACRONYMS = ("ai", "ml", "nlp", "llm", "sre", "qa", "ui", "ux", "gpu", "cpu", "api", "sql")
COMPANY_SUFFIXES = r"\b(inc|llc|corp|corporation|co|company|ltd|limited)\b"
BROAD_LOCATIONS = ("united states", "united states of america", "usa", "us", "u s", "north america")
WORK_MODES = ("remote", "hybrid", "onsite")
REMOTE_PATTERNS = (("remote", r"(?i)\b(remote|work\s*from\s*home|wfh|anywhere)\b"), ("hybrid", r"(?i)\bhybrid\b"), ("onsite", r"(?i)\b(on[-\s]?site|onsite|in\s+office)\b"))
EXPERIENCE_PATTERNS = (
    ("internship", r"(?i)\b(intern|internship|co[-\s]?op)\b"),
    ("entry", r"(?i)\b(entry[-\s]?level|junior|new\s*grad|associate)\b"),
    ("mid", r"(?i)\b(mid[-\s]?level|intermediate|level\s*ii|level\s*2)\b"),
    ("senior", r"(?i)\b(senior|sr\.?|lead|staff|principal|manager|director|head)\b"),
)
CLEARANCE_PATTERNS = (("top_secret", r"(?i)\btop secret\b"), ("secret", r"(?i)\bsecret clearance\b"), ("public_trust", r"(?i)\bpublic trust\b"), ("clearance_required", r"(?i)\bsecurity clearance\b"))
EXPERIENCE_LABELS = {"internship": ("intern", "internship", "co-op", "coop"), "entry": ("entry", "entry-level", "junior", "new grad", "associate"), "mid": ("mid", "mid-level", "intermediate"), "senior": ("senior", "lead", "staff", "principal", "manager", "director")}
CITIES = {"new york": "new york ny", "san francisco": "san francisco ca", "los angeles": "los angeles ca"}
# How places are written.
CITY_LABELS = ((r"(?i)^(new york( city)?(,?\s*ny)?|nyc)$", "New York, NY"), (r"(?i)^san francisco(,?\s*ca)?$", "San Francisco, CA"), (r"(?i)^los angeles(,?\s*ca)?$", "Los Angeles, CA"), (r"(?i)^remote(\s+[a-z]{2,})?$", "Remote"), (r"(?i)^hybrid$", "Hybrid"), (r"(?i)^onsite$", "Onsite"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it: Spark would write x out at each place."""
    return F.transform(F.array(x), f)[0]


def each(x: Column, f: Callable[[Column], Column]) -> Column:
    """The fields of the struct f(x) as columns of a select, computed once a row: let(), but for columns that many later steps use."""
    return F.inline(F.transform(F.array(x), f))


def squeeze(x: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def as_text(x: Column) -> Column:
    """Squeezed text, or null where nothing is left."""
    return let(squeeze(x), lambda t: F.when(t != "", t))


def found(x: Column, pattern: str) -> Column:
    """What a pattern finds, with one space between; on long texts many times quicker than to replace all that it doesn't find."""
    return F.array_join(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), " ")


def canon_ascii(x: Column) -> Column:
    return found(F.lower(x), "[a-z0-9]+")


def canon_unicode(x: Column) -> Column:
    return found(F.lower(F.coalesce(x, F.lit(""))), r"[\p{L}\p{N}]+")


def words(x: Column) -> Column:
    """Words of a canonical text; none for an empty one."""
    return F.array_remove(F.split(x, " "), "")


def as_float(x: Column) -> Column:
    """Lenient number: $ in front, thousands commas and a % at the end are dropped; anything else bad is null."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"^\$|%$", ""), ",", "").try_cast("double")


def as_bool(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "yes", "in stock", "available"), True).when(low.isin("false", "no", "out of stock", "sold out", "unavailable"), False)


def bounded(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(F.lower(w), F.lit(2), F.length(w)))


def title_case(x: Column) -> Column:
    """Titles that are mostly capitals or all small get title case; mixed ones stay as they are."""

    def of(text: Column) -> Column:
        counts = F.struct(*[F.length(F.regexp_replace(text, p, "")).alias(n) for n, p in (("letters", r"[^\p{L}]"), ("capitals", r"[^\p{Lu}]"), ("smalls", r"[^\p{Ll}]"))])
        even = let(counts, lambda n: (n["letters"] > 0) & ((n["capitals"] >= 0.65 * n["letters"]) | (n["smalls"] >= 0.95 * n["letters"])))
        cased = F.transform(F.split(text, " "), lambda w, i: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).when((i > 0) & F.lower(w).isin(*TITLE_STOPWORDS), F.lower(w)).otherwise(capitalised(w)))
        return F.when(even, F.array_join(cased, " ")).otherwise(text)

    return let(as_text(x), of)


def title_key(x: Column) -> Column:
    aliased = F.transform(words(canon_ascii(F.coalesce(x, F.lit("")))), lambda w: reduce(lambda c, kv: c.when(w == kv[0], kv[1]), list(TITLE_ALIASES.items())[1:], F.when(w == "sr", "senior")).otherwise(w))
    return F.array_join(F.filter(aliased, lambda w: ~w.isin(*TITLE_STOPWORDS)), " ")


def company_name(x: Column) -> Column:
    name = lambda text: F.regexp_replace(F.regexp_replace(text, r"(?i)^at ", ""), r"[\s|/,-]+$", "")
    return let(as_text(x), lambda text: F.when(~canon_ascii(text).isin(*UNKNOWN_COMPANIES), title_case(name(text))))


def company_key(x: Column) -> Column:
    return F.coalesce(squeeze(F.regexp_replace(canon_ascii(x), COMPANY_SUFFIXES, " ")), F.lit(""))


def work_mode(x: Column) -> Column:
    return let(F.regexp_replace(F.lower(as_text(x)), "^on-site$", "onsite"), lambda low: F.when(low.isin(*WORK_MODES), low))


def experience(x: Column) -> Column:
    return let(F.lower(as_text(x)), lambda low: reduce(lambda c, kv: F.when(low.isin(*kv[1]), kv[0]).otherwise(c), EXPERIENCE_LABELS.items(), low))


#: Strings of which one is in every text that a label's pattern fits: a plain search for them, which is many times quicker, spares most texts the pattern.
HINTS = {
    "remote": ("remote", "home", "wfh", "anywhere"), "hybrid": ("hybrid",), "onsite": ("site", "office"), "internship": ("intern", "op"), "entry": ("entry", "junior", "grad", "associate"), "mid": ("mid", "intermediate", "level"),
    "senior": ("senior", "sr", "lead", "staff", "principal", "manager", "director", "head"), "top_secret": ("top secret",), "secret": ("secret clearance",), "public_trust": ("public trust",), "clearance_required": ("security clearance",),
}


def first_pattern(x: Column, patterns) -> Column:
    """The label of the first pattern that is found in x."""
    may = lambda low, label: reduce(lambda a, b: a | b, [low.contains(h) for h in HINTS[label]])
    both = F.struct(x.alias("t"), F.lower(x).alias("low"))
    return let(both, lambda b: F.coalesce(*[F.when(may(b["low"], label) & b["t"].rlike(p), label) for label, p in patterns]))


def infer_work_mode(title: Column, location: Column, description: Column) -> Column:
    return first_pattern(F.concat_ws(" ", title, location, description), REMOTE_PATTERNS)


def infer_experience(title: Column, description: Column) -> Column:
    return first_pattern(F.concat_ws(" ", title, description), EXPERIENCE_PATTERNS)


def infer_clearance(title: Column, description: Column) -> Column:
    """The kind of security clearance that a listing asks for; null if none."""
    return first_pattern(F.concat_ws(" ", title, description), CLEARANCE_PATTERNS)


def location_name(x: Column) -> Column:
    short = lambda w: F.lower(w).isin(*ACRONYMS) | w.rlike("^[A-Za-z]{2}$") | F.lower(w).isin("us", "usa")
    case = lambda w: F.when(short(w), F.upper(w)).otherwise(capitalised(w))
    parts = lambda text: F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    plain = lambda text: F.array_join(F.transform(parts(text), lambda p: F.array_join(F.transform(F.split(p, " "), case), " ")), ", ")
    named = lambda text: F.coalesce(*[F.when(text.rlike(p), label) for p, label in CITY_LABELS], let(plain(text), lambda t: F.when(t != "", t)))
    return let(squeeze(F.replace(as_text(x), F.lit(" - "), F.lit(", "))), named)


def location_key(x: Column, mode: Column) -> Column:
    """City names with their state, once: the state is added, then a doubled one collapses."""
    low = F.regexp_replace(canon_ascii(x), r"\bnew york city\b", "new york")
    for city, full in CITIES.items():
        low = F.regexp_replace(F.regexp_replace(low, rf"\b{city}\b", full), rf"\b{full} {full.rsplit(' ', 1)[1]}\b", full)
    return F.when(as_text(x).isNull(), F.coalesce(F.when(mode.isin(*WORK_MODES), mode), F.lit("unspecified"))).otherwise(let(low, lambda t: F.when(F.coalesce(t, F.lit("")) != "", t).otherwise("unspecified")))


def location_quality(x: Column, mode: Column) -> Column:
    """missing, mode_only, broad, weak (two letters or less) or structured."""
    return quality_of_key(x, mode, location_key(x, mode))


def quality_of_key(x: Column, mode: Column, key: Column) -> Column:
    """The same where the key is known."""
    return F.when(as_text(x).isNull() & mode.isNull(), "missing").when(key.isin(*WORK_MODES), "mode_only").when(key.isin(*BROAD_LOCATIONS), "broad").when(F.length(canon_ascii(x)) <= 2, "weak").otherwise("structured")


# How salaries are written.
NUMBER = r"(\d[\d,]*(?:\.\d+)?)\s*([kK]?)"
SALARY_FORMS = {
    "range": rf"(?i)(usd|\$)?\s*{NUMBER}\s*(?:-|to)\s*(?:usd|\$)?\s*{NUMBER}",
    "single": rf"(?i)(usd|\$)?\s*{NUMBER}\s*/?\s*(?:year|yr|annum)",
    "from": rf"(?i)(?:from|starting\s+at|minimum|min\.?)\s*(usd|\$)?\s*{NUMBER}",
    "up_to": rf"(?i)(?:up\s+to|maximum|max\.?|capped\s+at)\s*(usd|\$)?\s*{NUMBER}",
}


def salary_parse(x: Column) -> Column:
    """struct(min, max, currency) of a range, a yearly amount, a least or a most, in this order; k counts thousands, a turned-round range is put right. The second amount of a range may repeat the currency."""
    none = F.lit(None).cast("double")
    amount = lambda n, k: F.regexp_replace(n, ",", "").try_cast("double") * F.when(F.lower(k) == "k", 1000.0).otherwise(1.0)
    shapes = {"range": lambda a, b: (F.least(a, b), F.greatest(a, b)), "single": lambda a, _: (a, a), "from": lambda a, _: (a, none), "up_to": lambda a, _: (none, a)}

    def found(form: str) -> Column:
        """The form's groups, each looked up once; a form that isn't there has no first amount."""
        pattern, last = SALARY_FORMS[form], 5 if form == "range" else 3
        groups = F.array(*[F.regexp_extract(x, pattern, i) for i in range(1, last + 1)])

        def of(g: Column) -> Column:
            low, high = shapes[form](amount(g[1], g[2]), amount(g[3], g[4]) if form == "range" else none)
            return F.when(g[1] != "", F.struct(low.alias("min"), high.alias("max"), F.when(g[0] != "", "USD").alias("currency")))

        return let(groups, of)

    return F.coalesce(*map(found, SALARY_FORMS))


def salary_format(low: Column, high: Column, currency: Column) -> Column:
    sign = F.when(F.upper(currency) == "USD", "$").otherwise(F.coalesce(F.concat(F.upper(currency), F.lit(" ")), F.lit("$")))
    money = lambda v: F.format_number(F.round(v), 0)
    second = F.when(sign == "$", "$").otherwise("")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(sign, money(low), F.lit(" - "), second, money(high))).otherwise(F.concat(sign, money(F.coalesce(high, low))))


def price_values(x: Column) -> Column:
    """All amounts after a $."""
    found = F.regexp_extract_all(x, F.lit(r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)"), F.lit(1))
    return F.transform(found, lambda p: F.regexp_replace(p, ",", "").cast("double"))


def plausible_price(prices: Column, title: Column) -> Column:
    """The largest price over a floor by the kind of product and up to 10,000, or else the largest from 50 on."""
    low = F.lower(F.coalesce(title, F.lit("")))
    floor = F.when(low.contains("5090"), 800.0).when(low.contains("rtx") | low.contains("geforce"), 250.0).otherwise(0.0)
    return F.coalesce(F.array_max(F.filter(prices, lambda p: (p >= floor) & (p <= 10000))), F.array_max(F.filter(prices, lambda p: p >= 50)))


def discount_pct(price: Column, old: Column) -> Column:
    return F.when((old > 0) & (price >= 0), F.round((old - price) / old * 100.0, 2))


def stock(x: Column) -> Column:
    low = F.lower(x)
    has = lambda *s: reduce(lambda a, b: a | b, [low.contains(t) for t in s])
    return F.when(has("sold out", "out of stock", "unavailable"), False).when(has("add to cart", "pickup", "ship it"), True)


def stock_key(in_stock: Column) -> Column:
    return F.when(in_stock, "in_stock").when(~in_stock, "out_of_stock").otherwise("unknown")


# How product titles are told apart.
PERIPHERALS = ("mouse", "keyboard", "headset", "earbuds", "speaker", "monitor", "webcam", "dock", "ssd", "hdd", "nvme", "ram", "ddr4", "ddr5", "psu", "power supply", "motherboard", "mobo", "case", "chassis", "cooler", "heatsink", "thermal paste", "thermal pad", "fan", "cable", "adapter", "riser", "water block", "backplate", "mount", "bracket", "hub", "controller")
TITLE_CLASSES = {"gpu_words": r"\b(rtx\s*\d{4}|radeon\s*(rx\s*)?\d{4}|graphics card|video card|gpu)\b", "computer": r"\b(desktop|gaming pc|pc|prebuilt|workstation|tower|gaming computer)\b", "strong_computer": r"\b(desktop|gaming pc|prebuilt|workstation|tower|gaming computer)\b", "is_5090": r"\b(rtx|geforce)\s*5090\b", "laptop": r"\b(laptop|notebook)\b"}


def title_class(x: Column) -> Column:
    """struct(gpu, computer, strong_computer, is_5090, laptop, peripheral) of a product title."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    is_ = {k: low.rlike(p) for k, p in TITLE_CLASSES.items()}
    peripheral = (low == "") | reduce(lambda a, b: a | b, [low.contains(k) for k in PERIPHERALS])
    return F.struct((is_["gpu_words"] & ~is_["laptop"] & ~is_["computer"]).alias("gpu"), is_["computer"].alias("computer"), is_["strong_computer"].alias("strong_computer"), is_["is_5090"].alias("is_5090"), is_["laptop"].alias("laptop"), peripheral.alias("peripheral"))


def short_text(x: Column, n: int) -> Column:
    text = F.coalesce(squeeze(x), F.lit(""))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…")))


def error_prefix(x: Column) -> Column:
    """The error type that a message begins with: capitals only, or a word ending in Error."""
    head = F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
    return F.when(head.startswith("QUEUE_ENQUEUE_ERROR["), "QUEUE_ENQUEUE_ERROR").when((head == F.upper(head)) & head.rlike("[A-Z]") | head.endswith("Error"), head)


def failure_diagnostics(error: Column) -> Column:
    """struct(category, source, stage, error_type, upstream_service) by the first rule that fits; null without a message."""
    raw, kind = F.trim(F.coalesce(error, F.lit(""))), error_prefix(error)
    low = F.lower(raw)

    def row(category: str, source: Column | str, stage: str, service: str | None) -> Column:
        return F.struct(F.lit(category).alias("category"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(stage).alias("stage"), kind.alias("error_type"), F.lit(service).cast("string").alias("upstream_service"))

    queue = F.coalesce(F.nullif(F.regexp_extract(raw, r"^QUEUE_ENQUEUE_ERROR\[([^\]]*)", 1), F.lit("")), F.lit("queue"))
    return (
        F.when(raw == "", None)
        .when(raw.startswith("QUEUE_ENQUEUE_ERROR["), row("queue_enqueue_failure", queue, "queue_enqueue", "redis"))
        .when((kind == "APIConnectionError") | raw.startswith("OPENAI_API_CONNECTION_ERROR:") | (raw == "Connection error."), row("upstream_connection_failure", "worker", "worker_upstream_request", "openai"))
        .when(raw.startswith("VALIDATION_ERROR:"), row("validation_failure", "worker", "payload_validation", None))
        .when(raw.startswith("NON_RETRYABLE_ERROR:"), row("non_retryable_failure", "worker", "worker_handler", None))
        .when(low.contains("blocked") & low.contains("budget"), row("budget_blocked", "api", "task_creation", None))
        .otherwise(row("task_execution_failure", "worker", "worker_execute", None))
    )


def retry_delay(attempt: Column, base: float = 30.0, most: float = 900.0) -> Column:
    """Seconds before the next attempt: base, doubled each time, up to most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost at prices per million tokens, to 8 decimals, halves up."""
    exact = (F.coalesce(tokens_in, F.lit(0)).cast("decimal(18,0)") * price_in.cast("decimal(12,6)") + F.coalesce(tokens_out, F.lit(0)).cast("decimal(18,0)") * price_out.cast("decimal(12,6)")) / F.lit(1000000).cast("decimal(7,0)")
    return F.round(exact, 8).cast("decimal(12,8)")
