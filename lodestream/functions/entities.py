"""Character references of HTML, decoded in one pass: each is looked at once, and what comes out of it isn't looked at again."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard's names, with their semicolon; those that also count without one, the longest first.
NAMED = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))


def numbered(n: int) -> str | None:
    """What the standard puts for code points that stand for bytes of an old Windows page; None for all others."""
    try:
        return bytes([n]).decode("cp1252") if 0x80 <= n <= 0x9F else None
    except UnicodeDecodeError:
        return None


OLD_BYTES = {str(n): c for n in range(0x80, 0xA0) if (c := numbered(n))}


def table(entries: dict[str, str]) -> Column:
    """A map that Spark folds into one constant."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def character(code: Column) -> Column:
    """The character of a code point as text; U+FFFD where there is none."""
    bad = (code <= 0) | ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF) | code.isNull()
    return F.when(bad, "�").otherwise(F.coalesce(F.try_element_at(table(OLD_BYTES), code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def decode(text: Column) -> Column:
    """text with its named, decimal and hexadecimal references as characters; & that begins none stays. &amp;lt; gives &lt;, not <."""

    def reference(piece: Column) -> Column:
        # a piece follows an &
        number, digits = F.regexp_extract(piece, "^#([0-9]+);?", 1), F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
        name, bare = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]{0,31});", 1), F.regexp_extract(piece, f"^({'|'.join(BARE)})", 1)
        after = lambda n: F.substring(piece, n + 1, F.length(piece))
        tail = lambda used: F.when(F.substring(piece, used + 1, F.lit(1)) == ";", after(used + 1)).otherwise(after(used))
        return (
            F.when(number != "", F.concat(character(F.when(F.length(number) <= 18, number.cast("long")).otherwise(F.lit(-1))), tail(F.length(number) + 1)))
            .when(digits != "", F.concat(character(F.when(F.length(F.ltrim(F.lit("0"), digits)) <= 8, F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(-1))), tail(F.length(digits) + 2)))
            .when(F.try_element_at(table(NAMED), name).isNotNull(), F.concat(F.try_element_at(table(NAMED), name), after(F.length(name) + 1)))
            .when(bare != "", F.concat(F.try_element_at(table({n: html5[n] for n in BARE}), bare), after(F.length(bare))))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    decoded = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), reference)
    return F.when(text.contains("&"), F.concat(pieces[0], F.array_join(decoded, ""))).otherwise(text)
