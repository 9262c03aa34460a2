"""Text normalisers, parsers and id makers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: joins lists in exported strings.
SEP = "<SEP>"
#: Field and record marks of extraction output.
FIELD_MARK, END_MARK = "<|#|>", "<|COMPLETE|>"


def md5_id(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def fact_text(s: Column, p: Column, o: Column) -> Column:
    """A triple as it is hashed; normalised phrases hold no quotes."""
    return F.concat(F.lit("('"), s, F.lit("', '"), p, F.lit("', '"), o, F.lit("')"))


def pair_key(a: Column, b: Column, sep: str = SEP) -> Column:
    return F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b))


def relation_ids(a: Column, b: Column) -> Column:
    """struct(id of the ordered pair, id of the reversed pair)."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.struct(md5_id(F.concat(low, high), "rel-").alias("id"), md5_id(F.concat(high, low), "rel-").alias("reversed_id"))


def strip(text: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def phrase(text: Column) -> Column:
    """Lower case; what is no ASCII letter, digit or blank becomes a blank; ends trimmed, inner runs kept."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def compat_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "[^a-z0-9 ]", " "))


def answer(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, the words a, an and the dropped, white space collapsed."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def compact_title(text: Column, limit: int = 120) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def summary(text: Column, limit: int = 250) -> Column:
    bare = strip(text)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.substring(bare, 1, limit), F.lit("...")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def sanitise(text: Column) -> Column:
    """Trimmed, without control characters other than tab and line ends."""
    return strip(F.regexp_replace(strip(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def without_thoughts(text: Column) -> Column:
    """Without an orphan beginning up to the first closing tag, and without whole thought blocks."""
    head = F.instr(text, "</think>")
    opened = F.instr(text, "<think>")
    orphan = (head > 0) & ((opened == 0) | (opened > head))
    rest = F.when(orphan, text.substr(head + F.lit(len("</think>")), F.length(text))).otherwise(text)
    return strip(F.regexp_replace(rest, r"(?s)<think>.*?</think>", ""))


def answer_part(text: Column, mark: str = "Answer:") -> Column:
    at = F.instr(text, mark)
    return strip(F.when(at > 0, text.substr(at + F.lit(len(mark)), F.length(text))).otherwise(text))


def float_or(text: Column, otherwise: float = 1.0) -> Column:
    return F.when(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), text.cast("double")).otherwise(F.lit(otherwise))


def truth(text: Column) -> Column:
    return F.lower(strip(text)).isin("true", "1", "yes", "t", "on")


def cut_identifier(text: Column, limit: int = 256) -> Column:
    return F.substring(text, 1, limit)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Tokens of the deterministic default tokenizer: runs of word characters and single other signs."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def split_list(text: Column) -> Column:
    """The distinct non-blank parts of a joined list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, SEP), strip), lambda x: x != ""))


def join_list(items: Column) -> Column:
    return F.array_join(items, SEP)


#: A field mark in any damaged form: bars lost, doubled or swapped for another sign, the core lost, doubled or escaped, one angle lost.
DAMAGED_MARK = r"<(?=#>|[^<>]*\|)[^<>#|]?\|*\\?#(?:\|*#)?\|*[^<>#|]?>|<\|+>|<\|#\|+(?!>)|(?<![<|])\|+#\|>"


def repair_marks(text: Column) -> Column:
    """Every damaged field mark written out whole (survey 8.10)."""
    return F.regexp_replace(text, DAMAGED_MARK, FIELD_MARK)


#: Outer quotes that go if none of the pair is inside, and wide signs besides letters and digits.
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》"))
WIDE_SIGNS = (("－", "-"), ("＋", "+"), ("／", "/"), ("＊", "*"), ("（", "("), ("）", ")"), ("—", "-"), ("　", " "))
_HAN, _LATIN = "[一-龥]", r"[A-Za-z0-9()\[\]@#$%!&*\-=+_]"


def once(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unquoted(x: Column, left: str, right: str) -> Column:
    inside = x.substr(F.lit(2), F.length(x) - 2)
    pair = (F.length(x) >= 2) & x.startswith(left) & x.endswith(right)
    return F.when(pair & ~inside.contains(left) & ~inside.contains(right), inside).otherwise(x)


def extracted(text: Column, inner_quotes: bool = False) -> Column:
    """An extracted name (survey 8.9): no line tags, ASCII letters, digits and brackets, no blanks beside Han signs, no outer quotes, no short numbers."""
    out = F.regexp_replace(text, r"(?i)</?(?:p|br)\s*>|<(?:p|br)/>", "")
    wide = "".join(chr(c + 0xFEE0) for c in range(33, 127) if chr(c).isalnum())
    out = F.translate(out, wide + "".join(w for w, _ in WIDE_SIGNS), "".join(chr(ord(w) - 0xFEE0) for w in wide) + "".join(n for _, n in WIDE_SIGNS))
    out = F.regexp_replace(out, rf"(?<={_HAN})\s+(?={_HAN}|{_LATIN})|(?<={_LATIN})\s+(?={_HAN})", "")
    for left, right in QUOTES:
        out = once(out, lambda x: _unquoted(x, left, right))  # noqa: B023
    if inner_quotes:
        out = F.regexp_replace(out, rf"[“”‘’]|['\"]+(?={_HAN})|(?<={_HAN})['\"]+", "")
        out = F.regexp_replace(out, "\u00a0|(?<=[^0-9])\u202f", " ")
    short = lambda x: (F.length(x) < 3) & x.rlike("^[0-9]+$") | (F.length(x) < 6) & x.rlike(r"^[0-9.]+$") & x.contains(".")
    return once(strip(out), lambda x: F.when(short(x), "").otherwise(x))
