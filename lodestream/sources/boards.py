"""Listing boards as tables of patterns: fields of a card, metadata of a top card, and the state of a captured page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from .html import strip

# Where boards keep a field, by board and field, in the order of trying.
_UNTIL = r"[^>]*>(.*?)</"
FIELDS = {
    "linkedin": {"company": (rf"base-search-card__subtitle{_UNTIL}", rf"job-search-card__subtitle{_UNTIL}"), "location": (rf"job-search-card__location{_UNTIL}",), "posted": ('<time[^>]*datetime="([^"]+)"', "<time[^>]*>(.*?)</time>"), "description": (rf"job-search-card__snippet{_UNTIL}",)},
    "indeed": {"company": (rf'data-testid="company-name"{_UNTIL}', rf"companyName{_UNTIL}"), "location": (rf'data-testid="text-location"{_UNTIL}', rf"companyLocation{_UNTIL}"), "posted": (rf'data-testid="myJobsStateDate"{_UNTIL}', rf'data-testid="date"{_UNTIL}'), "description": (rf"job-snippet{_UNTIL}", rf'data-testid="job-snippet"{_UNTIL}')},
    "glassdoor": {"company": (rf"Employer{_UNTIL}", rf"compactEmployerName{_UNTIL}"), "location": (rf'data-test="location"{_UNTIL}', rf"location{_UNTIL}"), "posted": (rf'data-test="detailText"{_UNTIL}',), "description": (rf"jobDescriptionSnippet{_UNTIL}",)},
    "handshake": {"company": (rf"employer{_UNTIL}",), "location": (rf"location{_UNTIL}",), "posted": (rf"posted{_UNTIL}",), "description": (rf"description{_UNTIL}",)},
}
JOB_URLS = {
    "linkedin": (r"linkedin\.com/jobs/view/", "/jobs/view/"), "indeed": (r"indeed\.com/(?:viewjob|rc/clk)", "/viewjob"), "glassdoor": (r"glassdoor\.com/.+?-job-listing-", "/Job/.+?-job-listing-", r"glassdoor\.com/partner/jobListing\.htm", r"/partner/jobListing\.htm"),
    "handshake": (r"joinhandshake\.com/.*/jobs/", "/jobs/[0-9]+", "/stu/jobs/[0-9]+"),
}
# Hints in a card's plain text, for what the patterns don't find.
_VALUE = r"\s*[:|-]?\s*([A-Za-z0-9&().,\- ]{2,80})"
HINTS = {"company": rf"(?i)(?:company|employer|hiring(?:\s+company)?|organization){_VALUE}", "location": rf"(?i)(?:location|based in|city|area){_VALUE}", "posted": r"(?i)(\b(?:just posted|today|yesterday|[0-9]{1,3}\+?\s*(?:minute|hour|day|week|month)s?\s+ago|[0-9]{1,3}d)\b)"}
DESCRIPTION = 500
# The top card of a listing's own page.
TOP_COMPANY = tuple(rf"{mark}{_UNTIL}" for mark in ("job-details-jobs-unified-top-card__company-name", "jobs-unified-top-card__company-name", "topcard__org-name-link"))
TOP_TEXTS = tuple(rf"{mark}[^>]*>(.*?)</div>" for mark in ("job-details-jobs-unified-top-card__primary-description-container", "job-details-jobs-unified-top-card__tertiary-description-container")) + tuple(rf"{mark}{_UNTIL}" for mark in ("tvm__text--low-emphasis", "text-body-small"))
TOP_NOISE = r"(?i)\b(applicant|applicants|applied|promoted|easy apply|actively recruiting|recruiting|response rate|alumni)\b"
TOP_PLACE = r"(?i)\b(remote|hybrid|onsite|on-site|united states|united kingdom|canada|[A-Za-z .'-]+,\s*[A-Z]{2}\b)\b"
AGE_AMOUNT = r"\b(\d+|a|an)\s*(minute|min|hour|hr|day|d|week|wk|month|mo)s?\s+ago\b"
AGE_PLUS = r"\b(\d+)\+\s*days?\s+ago\b"


def pattern_text(html: Column, patterns: tuple[str, ...]) -> Column:
    """The first non-empty group 1 of the patterns, without tags. A later pattern is looked for only where the earlier ones give nothing."""
    return F.coalesce(*[text.as_text(strip(F.regexp_extract(html, f"(?is){p}", 1))) for p in patterns], F.lit(None).cast("string"))


def card_fields(board: Column, html: Column) -> Column:
    """struct(company, location, posted, description) of a card's HTML: the board's patterns in order, or else hints in its plain text; of a board that has no patterns the hints alone."""

    def of(plain: Column) -> Column:
        hint = lambda k: text.as_text(F.regexp_extract(plain, HINTS[k], 1))
        by_board = lambda k: reduce(lambda c, b: c.when(F.lower(board) == b, pattern_text(html, FIELDS[b][k])), FIELDS, F)
        return F.struct(*[F.coalesce(by_board(k), hint(k)).alias(k) for k in ("company", "location", "posted")], F.nullif(F.substring(F.coalesce(by_board("description"), plain), 1, DESCRIPTION), F.lit("")).alias("description"))

    return text.let(strip(F.coalesce(html, F.lit(""))), of)


def token_age(token: Column) -> Column:
    """Days that a token like Reposted 2 weeks ago speaks of; null if it is no date."""
    low = F.regexp_replace(F.lower(token), r"^\s*reposted\s+", "")
    amount, unit = F.coalesce(F.regexp_extract(low, AGE_AMOUNT, 1).try_cast("long"), F.lit(1)), F.regexp_extract(low, AGE_AMOUNT, 2)
    days = F.when(unit.rlike("^(min|h)"), F.lit(0)).when(unit.startswith("w"), amount * 7).when(unit.startswith("mo"), amount * 30).otherwise(amount)
    return F.when(low.rlike(r"\b(today|just posted)\b"), F.lit(0)).when(low.rlike(r"\byesterday\b"), F.lit(1)).when(low.rlike(AGE_PLUS), F.regexp_extract(low, AGE_PLUS, 1).try_cast("long")).when(low.rlike(AGE_AMOUNT), days).cast("long")


def top_tokens(html: Column) -> Column:
    """The distinct parts, in order, of a top card's texts, split at middle dots and bullets."""
    texts = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(f"(?is){p}"), F.lit(1)) for p in TOP_TEXTS]))
    parts = F.flatten(F.transform(texts, lambda t: F.split(strip(t), "[·•]")))
    return F.array_distinct(F.filter(F.transform(parts, text.squeeze), lambda t: t != ""))


def top_card(html: Column, title: Column) -> Column:
    """struct(company, location, posted, age_days, tokens): each token goes to the first class that it fits and that is still free: a date, a place, and, if no pattern names it, a company."""

    def of(tokens: Column) -> Column:
        noise = lambda t: t.rlike(TOP_NOISE)
        place = lambda t: ~noise(t) & t.rlike(TOP_PLACE)
        posted = F.get(F.filter(tokens, lambda t: token_age(t).isNotNull()), F.lit(0))
        # the token that gave the date names no place; other dates may
        location = F.get(F.filter(tokens, lambda t: place(t) & ~t.eqNullSafe(posted)), F.lit(0))
        named = lambda t: (F.length(t) >= 2) & (F.lower(t) != F.lower(text.squeeze(F.coalesce(title, F.lit(""))))) & ~noise(t) & token_age(t).isNull() & ~place(t) & t.rlike(r"\p{L}")
        company = F.coalesce(pattern_text(html, TOP_COMPANY), F.get(F.filter(tokens, named), F.lit(0)))
        return F.struct(company.alias("company"), location.alias("location"), posted.alias("posted"), token_age(posted).alias("age_days"), tokens.alias("tokens"))

    return text.let(top_tokens(F.coalesce(html, F.lit(""))), of)


def is_job_url(board: str, url: Column) -> Column:
    return reduce(lambda a, b: a | b, [url.rlike(f"(?i){p}") for p in JOB_URLS[board]])


# Two sets of rules for captured search pages. signals: patterns of the page's text; marks: parts of an address's path; status: status codes that say the same; states:
# signals in their priority, with the source's status and the page's state; what none fits comes last.
PAGE_RULES = {
    "handshake": {
        "signals": {"login_wall": (r"\blog in\b", r"\bsign in\b", r"continue\s+with\s+your\s+school", "sign in to view", "please log in"), "empty": (r"\bno results\b", r"\b0 jobs\b", "no jobs found", "we couldn'?t find any jobs", "try adjusting your filters"), "context": (r"\bjob postings\b", r"\bfilters\b", r"\bsearch results\b", r"\bjoinhandshake\b")},
        "marks": {"search": ("/stu/postings", "/students/jobs/search", "/jobs/search"), "login_wall": ("/login", "/sign_in", "/users/sign_in", "/session", "/sessions", "/auth")},
        "status": {"auth_required": (401, 403)},
        "states": (("auth_required", "auth_blocked", "auth_blocked"), ("redirect", "upstream_failure", "unexpected_redirect"), ("empty", "empty_success", "empty_results"), ("layout", "layout_mismatch", "selector_mismatch"), (None, "empty_success", "no_cards_found")),
    },
    "glassdoor": {
        "signals": {"anti_bot": ("captcha", "verify you are human", "security check", "unusual traffic", "enable javascript and cookies"), "consent_wall": ("accept all cookies", "privacy preference center", "cookie preferences", "consent preferences"), "login_wall": ("sign in", "log in", "join glassdoor", "continue with email", "create an account"), "empty": (r"\b0 jobs\b", r"\bno results\b", "try a different keyword", "no jobs to display", "didn'?t find any jobs"), "context": ("glassdoor", r"\bsearch results\b", r"\bjobs in\b", "jobcard", "jobListings")},
        "marks": {"search": ("/job/jobs.htm",), "login_wall": ("/login", "/member/home", "/member/profile/login_input.htm", "/profile/login_input.htm"), "anti_bot": ("/captcha",)},
        "status": {"anti_bot": (403, 429)},
        "states": (("anti_bot", "anti_bot_blocked", "anti_bot_detected"), ("consent_wall", "consent_blocked", "consent_wall_detected"), ("login_wall", "auth_blocked", "login_wall_detected"), ("redirect", "upstream_failure", "unexpected_redirect"), ("empty", "empty_success", "true_empty_results"), (None, "layout_mismatch", "layout_mismatch")),
    },
}


def url_part(url: Column, name: str) -> Column:
    """scheme, host, path or query of any text that looks like an address; captured ones hold what a strict parser refuses."""
    return F.regexp_extract(url, {"scheme": "^([A-Za-z][A-Za-z0-9+.-]*)://", "host": "://([^/?#]*)", "path": "://[^/?#]*([^?#]*)", "query": r"^[^?#]*\?([^#]*)"}[name], 1)


def comparable(url: Column) -> Column:
    """An address without its fragment and trailing slashes, scheme and host lower-cased, the query sorted."""
    u = F.trim(F.coalesce(url, F.lit("")))
    query = F.array_join(F.array_sort(F.array_remove(F.split(url_part(u, "query"), "&"), "")), "&")
    return F.concat_ws("|", F.lower(url_part(u, "scheme")), F.lower(url_part(u, "host")), F.regexp_replace(url_part(u, "path"), "/+$", ""), query)


def page_state(board: str, *, requested: Column, final: Column, html: Column, status: Column, cards: Column) -> Column:
    """struct(source_status, page_state, login_wall, empty, redirect, layout, and, where the board has them, auth_required, anti_bot, consent_wall) of a captured search page.

    A page with cards is a success whatever else it says. Without any, the first of the board's states whose signal is there holds. A final address that is missing is the requested one; a redirect
    leads to another address that is no search page, nor, where they count, a listing.
    """
    rules = PAGE_RULES[board]
    page, last = F.coalesce(html, F.lit("")), F.coalesce(F.nullif(F.trim(final), F.lit("")), requested)
    path = lambda url: F.lower(F.coalesce(url_part(url, "path"), F.lit("")))
    marked = lambda url, name: reduce(lambda a, b: a | b, [path(url).contains(m) for m in rules["marks"].get(name, ())], F.lit(False))
    coded = lambda name: F.coalesce(status.isin(*rules["status"][name]), F.lit(False)) if name in rules["status"] else F.lit(False)
    found = {name: reduce(lambda a, b: a | b, [page.rlike(f"(?i){p}") for p in patterns]) | marked(last, name) | coded(name) for name, patterns in rules["signals"].items()}
    listing = is_job_url(board, last) if board == "glassdoor" else F.lit(False)
    found["redirect"] = (last != "") & (comparable(last) != comparable(requested)) & ~marked(last, "search") & ~listing
    if "auth_required" in rules["status"]:
        found["auth_required"] = found["login_wall"] | coded("auth_required")
    context = found.pop("context") | marked(requested, "search")

    def of(s: Column) -> Column:
        barred = reduce(lambda a, b: a | b, [s[n] for n in ("auth_required", "anti_bot", "consent_wall", "login_wall") if n in found])
        layout = (cards <= 0) & ~s["empty"] & ~barred & s["context"]
        when = lambda name: F.lit(True) if name is None else layout if name == "layout" else s[name]
        pick = lambda i: reduce(lambda c, row: c.when(when(row[0]), F.lit(row[i])), rules["states"], F.when(cards > 0, F.lit(("success", "results")[i - 1])))
        mismatch = layout if board == "handshake" else pick(1) == "layout_mismatch"
        return F.struct(pick(1).alias("source_status"), pick(2).alias("page_state"), *[s[n].alias(n) for n in found], mismatch.alias("layout"))

    return text.let(F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in found.items()], F.coalesce(context, F.lit(False)).alias("context")), of)
