"""Secret scan with DataFrame functions only: fixed patterns, and windows of high entropy in other long strings.

Spans come from `split` and `regexp_extract_all` of one pattern: the gaps and the hits in turn give every place.
Entropy runs over each candidate with a window whose character counts are kept up to date: one count goes down, one goes
up, and the sum of c * log2(c) changes by the two terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three patterns, and the least length of the part that counts.
PATTERNS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = [*PATTERNS, "entropy"]
#: Patterns to look with: as above where a shorter match would fail anyway; only `assign` can fail and hide a later match.
_LOOK = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: Strings whose windows are measured; window; bits that a window needs, by class of the string's characters.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "alphanumeric": (r"^[A-Za-z0-9]+$", 3.6), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.7)}
#: Separators at the ends of a string.
ENDS = r"^[/_=+-]+|[/_=+-]+$"
#: Allow-list of whole strings: words, also joined ones and with a trailing number; numbers; UUIDs.
ALLOWED = r"^(?:[A-Za-z][A-Za-z/_=+-]*[0-9]{0,4}|[0-9/_=+-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
#: Allow-list of windows: those with a placeholder, or with one character this often in a row.
PLACEHOLDER, RUN = r"(?i:example|placeholder|changeme|x{4,}|dummy)", 8
_REPEAT = rf"(.)\1{{{RUN - 1},}}"

_SPAN = "struct<kind:int,start:int,end:int>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _places(text: Column, look: str, kind: int, part: int, least: int) -> Column:
    """Spans of the matches whose `part` has `least` characters, in order; code points, end exclusive."""
    gaps, hits, parts = F.split(text, look, -1), F.regexp_extract_all(text, F.lit(look), F.lit(0)), F.regexp_extract_all(text, F.lit(look), F.lit(part))
    rows = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))),
        parts, lambda x, p: F.struct(x.gap.alias("gap"), x.hit.alias("hit"), (F.length(p) >= least).alias("ok")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x.hit).alias("end"))
        return F.struct((start + x.hit).alias("at"), F.when(x.ok, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc.out)
    return F.when(text.rlike(look), found).otherwise(_none())


def _plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_range(string: Column, bits: Column) -> Column:
    """struct(first, last): the first and last window start (-1: none) of `string` whose Shannon entropy reaches `bits`."""
    codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), F.ascii)

    def step(acc: Column, i: Column) -> Column:
        new, old = F.get(acc.codes, i), F.when(i >= WINDOW, F.get(acc.codes, i - WINDOW)).otherwise(F.lit(-1))
        gone = F.coalesce(F.get(acc.counts, old), F.lit(0))
        come = F.get(acc.counts, new) - F.when(new == old, F.lit(1)).otherwise(F.lit(0))
        total = acc.total - _plogp(gone) + _plogp(gone - 1) - _plogp(come) + _plogp(come + 1)
        enough = (i >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= acc.bits)
        at = i - (WINDOW - 1)
        return F.struct(
            acc.codes.alias("codes"), acc.bits.alias("bits"),
            F.transform(acc.counts, lambda v, j: v + (j == new).cast("int") - (j == old).cast("int")).alias("counts"),
            total.alias("total"),
            F.when((acc.first < 0) & enough, at).otherwise(acc.first).alias("first"), F.when(enough, at).otherwise(acc.last).alias("last"),
        )

    start = F.struct(
        codes.alias("codes"), bits.alias("bits"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.length(string) - 1), start, step, lambda acc: F.struct(acc.first.alias("first"), acc.last.alias("last")))


def _allowed_out(string: Column) -> Column:
    """Parts of `string`, in order, that together have every window without a placeholder or run, and no other window."""
    m = len(PATTERNS)
    mark = lambda x, need: F.struct((x.start + need - 1).alias("upto"), (x.end - need + 1).alias("after"))
    word = lambda x: F.when(F.lower(F.substring(string, x.start + 1, 1)) == "x", F.lit(4)).otherwise(x.end - x.start)
    marks = F.concat(
        F.transform(_places(string, PLACEHOLDER, m, 0, 0), lambda x: mark(x, word(x))), F.transform(_places(string, _REPEAT, m, 0, 0), lambda x: mark(x, F.lit(RUN)))
    )

    def step(acc: Column, x: Column) -> Column:
        part = F.struct(F.lit(m).alias("kind"), acc.at.alias("start"), x.upto.alias("end"))
        out = F.when(x.upto - acc.at >= WINDOW, F.concat(acc.out, F.array(part))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, x.after).alias("at"), out.alias("out"))

    def last(acc: Column) -> Column:
        part = F.struct(F.lit(m).alias("kind"), acc.at.alias("start"), F.length(string).alias("end"))
        return F.when(F.length(string) - acc.at >= WINDOW, F.concat(acc.out, F.array(part))).otherwise(acc.out)

    whole = F.array(F.struct(F.lit(m).alias("kind"), F.lit(0).alias("start"), F.length(string).alias("end")))
    marked = string.rlike(PLACEHOLDER) | string.rlike(_REPEAT)
    return F.when(marked, F.aggregate(F.array_sort(marks), F.struct(F.lit(0).alias("at"), _none().alias("out")), step, last)).otherwise(whole)


def _joined(parts: Column) -> Column:
    """struct(first, last) over the parts of a string: the first and last window of all (-1: none)."""
    hot = F.filter(parts, lambda p: p.range.first >= 0)
    at = lambda which: F.transform(hot, lambda p: p.start + p.range[which])
    return F.struct(F.coalesce(F.array_min(at("first")), F.lit(-1)).alias("first"), F.coalesce(F.array_max(at("last")), F.lit(-1)).alias("last"))


def _uncovered(p: Column, base: Column) -> Column:
    """The parts of the place `p` of WINDOW characters at least that no base span covers, in order."""
    over = F.array_sort(F.transform(
        F.filter(base, lambda b: (b.start < p.end) & (p.start < b.end)), lambda b: F.struct(b.start.alias("start"), b.end.alias("end"))
    ))

    def step(acc: Column, b: Column) -> Column:
        part = F.struct(F.lit(len(PATTERNS)).alias("kind"), acc.at.alias("start"), b.start.alias("end"))
        out = F.when(b.start - acc.at >= WINDOW, F.concat(acc.out, F.array(part))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, b.end).alias("at"), out.alias("out"))

    def last(acc: Column) -> Column:
        part = F.struct(F.lit(len(PATTERNS)).alias("kind"), acc.at.alias("start"), p.end.alias("end"))
        return F.when(p.end - acc.at >= WINDOW, F.concat(acc.out, F.array(part))).otherwise(acc.out)

    return F.aggregate(over, F.struct(p.start.alias("at"), _none().alias("out")), step, last)


def _entropy_spans(text: Column, base: Column) -> Column:
    """Spans outside the base spans with windows of high entropy, but for allowed strings.

    A string that base spans cover in part is measured in its other parts; separators at the ends of such a part don't
    count for its class and the allow-list.
    """
    places = _places(text, CANDIDATE, len(PATTERNS), 0, WINDOW)
    free = F.flatten(F.transform(places, lambda p: F.transform(_uncovered(p, base), lambda u: F.struct(
        u.start.alias("start"), u.end.alias("end"), ((u.start > p.start) | (u.end < p.end)).alias("cut")
    ))))
    strings = F.transform(free, lambda p: F.struct(p.start.alias("start"), F.substring(text, p.start + 1, p.end - p.start).alias("string"), p.cut.alias("cut")))
    strings = F.transform(strings, lambda s: F.struct(
        s.start.alias("start"), s.string.alias("string"), F.when(s.cut, F.regexp_replace(s.string, ENDS, "")).otherwise(s.string).alias("core")
    ))
    strings = F.filter(strings, lambda s: (s.core != "") & ~s.core.rlike(ALLOWED))
    need = lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(b)) for p, b in CLASSES.values()])
    parts = lambda s: F.transform(_allowed_out(s.string), lambda w: F.struct(
        w.start.alias("start"), entropy_range(F.substring(s.string, w.start + 1, w.end - w.start), need(s.core)).alias("range")
    ))
    ranged = F.transform(strings, lambda s: F.struct(s.start.alias("start"), _joined(parts(s)).alias("range")))
    hot = F.filter(ranged, lambda r: r.range.first >= 0)
    return F.transform(hot, lambda r: F.struct(
        F.lit(len(PATTERNS)).alias("kind"), (r.start + r.range.first).alias("start"), (r.start + r.range.last + WINDOW).alias("end")
    ))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def with_spans(docs: DataFrame, text: Column, base: str, added: str) -> DataFrame:
    """`docs` with the base spans and the added ones, each an array of struct(kind, start, end)."""
    found = docs.withColumn(base, F.concat(*[_places(text, _LOOK[k], i, part, least) for i, (k, (_, part, least)) in enumerate(PATTERNS.items())]))
    return found.withColumn(added, F.when(text.rlike(CANDIDATE), _entropy_spans(text, F.col(base))).otherwise(_none()))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Null text counts as empty, which has no spans; rows that repeat give equal rows; no rows give no rows; a null doc_id
    stays null. Nothing shuffles.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = with_spans(rows, F.col("text"), "base", "added")
    count = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long")
    return held.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """`docs` with every span of the text replaced by `mark` (overlapping spans by one), the length column, if any, brought up to date.

    All rows and columns stay; a null text stays null.
    """
    own = [F.col(f"`{c}`").alias(c) for c in docs.columns]
    held = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    held = with_spans(held, F.col("t"), "base", "added")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc.out, F.substring(F.col("t"), acc.at + 1, s.start - acc.at), F.lit(mark))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, piece).otherwise(acc.out).alias("out"))

    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc.out, F.substring(F.col("t"), acc.at + 1, F.length("t") - acc.at)),
    )
    clean = F.when(F.size(F.concat("base", "added")) > 0, done).otherwise(F.col(f"row.`{text}`"))
    held = held.select("row", clean.alias("clean"), "base", "added")
    put = {text: F.col("clean"), chars: F.when(F.size(F.concat("base", "added")) > 0, F.length("clean").cast("long")).otherwise(F.col(f"row.`{chars}`")) if chars in docs.columns else None}
    return held.select(*[put[c].alias(c) if put.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
