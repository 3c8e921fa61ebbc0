"""Search plans against a plain loop."""

import random
import re

from lodestream.operators import query_plans as qp

SCHEMA = "request_id long, explicit string, titles array<string>, locations array<string>, keywords array<string>, levels array<string>, remote boolean, most int, per_pair int, expand boolean"


def plain(explicit, titles, locations, keywords, levels, remote, most, per_pair, expand):
    squeeze = lambda x: " ".join((x or "").split())
    canon = lambda x: " ".join(re.sub(r"[^a-z0-9\s]+", " ", (x or "").lower()).split())
    far = lambda x: bool(re.search(qp.REMOTE, x))

    def once(values):
        kept = [squeeze(v) for v in values or [] if squeeze(v)]
        return [v for i, v in enumerate(kept) if v.lower() not in [x.lower() for x in kept[:i]]]

    def variants(title):
        a = once([t.replace("{}", title) for lv in levels or [] for t in qp.LEVELS.get(lv, ()) if canon(t.replace("{}", title)) != canon(title)])
        b = once([n for p, names in qp.SYNONYMS if re.search(p, title) for n in names])
        c = once([f"{qp.ROLES[k]} {title}" for k in map(canon, keywords or []) if k and k not in canon(title) and k in qp.ROLES])
        out = [(title, "base_title")]
        for i in range(max(len(a), len(b), len(c)) if expand else 0):
            out += [(x[i], kind) for x, kind in ((a, "seniority"), (b, "title_synonym"), (c, "role_specialization")) if i < len(x)]
        return [v for i, v in enumerate(out) if v[0].lower() not in [x[0].lower() for x in out[:i]]][: max(1, per_pair)]

    titles, places = once(titles), once(locations)
    if remote and not any(map(far, places)):
        places.append("Remote")
    names = {p: list(qp.REMOTE_NAMES) if far(p) else [p] for p in places}
    put = lambda what, where: what if far(where) and far(what) else f"{what} {where}"
    explicit, found = squeeze(explicit), []
    if explicit:
        found += [(put(explicit, names[p][0]), p, explicit, "explicit_query") for p in places]
    found += [(put(v, names[p][0]), p, t, kind) for p in places for t in titles for v, kind in variants(t)]
    if expand:
        found += [(put(t, n), p, t, "base_title_location_synonym") for p in places for t in titles for n in names[p][1:]]
    seen, out = set(), []
    for row in found:
        if row[0].lower() not in seen and len(out) < max(1, min(most, qp.MOST_QUERIES)):
            seen.add(row[0].lower())
            out.append((len(out) + 1, *row))
    return out


def test_plans(spark):
    rng = random.Random(4)
    some = lambda values, n: [rng.choice(values) for _ in range(rng.randrange(n))]
    rows = []
    for i in range(120):
        rows.append((i, rng.choice(["", None, "Kiln  lead", "remote kiln"]), some(["Software Engineer", "senior data engineer", "Kiln Keeper", "kiln keeper ", "", None, "Remote Machine Learning Engineer"], 4), some(["Oslo", "oslo", "Remote", "anywhere", "Work from home", " "], 4), some(["backend", "API", "x", "Full-Stack", "kiln", None], 4), some(["entry", "mid", "senior", "lead"], 3), rng.random() < 0.4, rng.choice([1, 5, 12, 99, 0]), rng.choice([1, 2, 4, 9]), rng.random() < 0.7))
    got = {}
    for r in qp.plan_queries(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["request_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {r[0]: w for r in rows if (w := plain(*r[1:]))}


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, ["Kiln Lead"], None, None, None, None, None, None, None), (2, None, None, ["Oslo"], None, None, None, None, None, None), (3, None, ["Kiln Lead"], ["Oslo"], None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in qp.plan_queries(rows).collect()] == [(3, 1, "Kiln Lead Oslo", "Oslo", "Kiln Lead", "base_title")]
    assert qp.plan_queries(rows.filter("false")).collect() == []
