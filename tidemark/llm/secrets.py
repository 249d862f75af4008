"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by their patterns alone. Weak candidates (short access identifiers, bare mixed strings, endpoints)
say little by themselves: they are reported only where complementary parts of a credential lie within one scope, which
an interval join over scope-sized buckets finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Patterns of the base kinds, in order, with the group that must have so many characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters or more
#: Weak candidates: identifiers by name, bare strings (upper and lower case and digits are asked for), endpoints.
WEAK_ID = r"""((?i:access_?key(?:_?id)?|client_?id|user(?:name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""
WEAK_SECRET = r"[A-Za-z0-9+/]{24,}"
ENDPOINT = r"https?://[A-Za-z0-9.:/_-]{4,}"
KINDS = ("assign", "access", "hex", "identifier", "string", "endpoint")
#: Code points between the parts of a credential, from the end of one to the start of the next, at most.
SCOPE = 200
#: Matches of a text that are added up, or cut out, at once: work grows with their number, not with its square.
BLOCK = 64
MARK = "[secret]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: inside other functions an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(values: Column) -> Column:
    """values (bound) in slices of BLOCK."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<int>>"))


def _before(values: Column, op) -> Column:
    """For each value (integers from 0 on) what op (a sum or a maximum) makes of all values before it."""
    none = F.array().cast("array<int>")

    def along(some: Column, value) -> Column:
        step = lambda acc, x: F.struct(op(acc["held"], value(x)).alias("held"), F.concat(acc["out"], F.array(acc["held"])).alias("out"))
        return F.aggregate(some, F.struct(F.lit(0).alias("held"), none.alias("out")), step)

    inner = _let(values, lambda v: F.transform(_blocks(v), lambda block: along(block, lambda x: x)))
    shifted = lambda block, a: F.transform(block["out"], lambda v: op(a, v))
    return _let(inner, lambda blocks: F.flatten(F.zip_with(blocks, along(blocks, lambda x: x["held"])["out"], shifted)))


def _matches(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end>> of the pattern's leftmost matches, in code points.

    What lies between matches comes from splitting by the same pattern; running sums of the lengths of both give the
    places. keep(match) tells whether a match counts.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(hits))
        steps = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), F.length(h).alias("n"), h.alias("hit")))
        return _let(steps, lambda s: F.zip_with(_before(F.transform(s, lambda x: x["gap"] + x["n"]), lambda a, b: a + b), s, span))

    def span(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit"))

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    kept = spans if keep is None else F.filter(spans, lambda s: keep(s["hit"]))
    return F.transform(F.coalesce(kept, none), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base spans and weak spans, each array<struct<start, kind, end>>; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 12
    base = F.concat(
        _tagged(_matches(t, ASSIGN, value), 0),
        _tagged(_matches(t, ACCESS, lambda hit: F.length(hit) >= 18), 1),
        _tagged(_matches(t, HEX), 2),
    )
    weak = F.concat(_tagged(_matches(t, WEAK_ID), 3), _tagged(_matches(t, WEAK_SECRET, mixed), 4), _tagged(_matches(t, ENDPOINT), 5))
    return rows.select("doc_id", F.xxhash64("text", F.length("text")).alias("text_key"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key and the weak spans that complementary parts confirm.

    Parts are within scope when at most `scope` code points lie between the end of one and the start of the other.
    A bare string needs an identifier (access or weak) in its scope, a weak identifier a secret (assign, hex or bare
    string), an endpoint both. Weak spans that overlap a base span or a stronger weak one are part of that.
    """
    both = found.where(F.size("weak") > 0).distinct()
    parts = both.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "text_key", "s.*")
    # Two parts at most `scope` apart: a bucket that one reaches, or its neighbour, is reached by the other.
    low, high = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    weak = parts.where("kind >= 3").withColumn("bucket", F.explode(F.sequence(low - 1, high + 1)))
    near = parts.select("doc_id", "text_key", F.col("start").alias("s2"), F.col("kind").alias("k2"), F.col("end").alias("e2"), F.explode(F.sequence(low, high)).alias("bucket"))
    w, n = weak.alias("w"), near.alias("n")
    same = F.col("w.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("w.text_key") == F.col("n.text_key")) & (F.col("w.bucket") == F.col("n.bucket"))
    close = same & (F.greatest("w.start", "n.s2") - F.least("w.end", "n.e2") <= scope)
    overlaps = (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2"))
    met = w.join(n, close).select("w.doc_id", "w.text_key", "start", "kind", "end", "k2", overlaps.alias("overlaps"))
    apart = ~F.col("overlaps")
    met = met.groupBy("doc_id", "text_key", "start", "kind", "end").agg(
        F.max(F.col("overlaps") & (F.col("k2") < F.col("kind"))).alias("covered"),
        F.max(apart & F.col("k2").isin(1, 3)).alias("identifier"),
        F.max(apart & F.col("k2").isin(0, 2, 4)).alias("secret"),
    )
    needs = F.when(F.col("kind") == 3, F.col("secret")).when(F.col("kind") == 4, F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    kept = met.where(~F.col("covered") & needs)
    return kept.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and added spans (array<struct<start, kind, end>>, kind an index in KINDS) for every row.

    Null texts are empty and hold nothing; rows with a null id and repeated rows give a row each. Places are code
    points, ends exclusive.
    """
    found = written(candidates(docs, id_col, text_col), "secrets")
    more = linked(found, scope)
    f, m = found.alias("f"), more.alias("m")
    same = F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_key") == F.col("m.text_key"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return f.join(m, same, "left").select("f.doc_id", "f.text_key", "base", F.coalesce("added", none).alias("added"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans, and all spans as text."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def redacted(docs: DataFrame, mark: str = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in `text` (overlapping ones as one) replaced by `mark`; texts without spans stay as they are."""
    found = find_secrets(docs, id_col=id_col, text_col=text_col).where(F.size("base") + F.size("added") > 0)
    spans = F.array_sort(F.concat("base", "added"))
    hit = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), spans.alias("__spans")).dropDuplicates(["__id", "__key"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The table's own columns go through in one struct, whatever their names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text, F.length(text)).alias("__key"), F.col(id_col).cast("long").alias("__id")).alias("d")
    h = hit.alias("h")
    joined = keyed.join(h, F.col("d.__id").eqNullSafe(F.col("h.__id")) & (F.col("d.__key") == F.col("h.__key")), "left")
    source, spans_of = F.col("row")[text_col], F.col("__spans")
    ends = F.transform(spans_of, lambda s: s["end"])
    reach = _before(ends, lambda a, b: F.greatest(a, b))
    # Kept pieces: from where the spans before reach to, up to a span; inside another span there is none.
    pieces = F.filter(F.zip_with(reach, spans_of, lambda r, s: F.struct(r.alias("a"), s["start"].alias("b"))), lambda p: p["b"] >= p["a"])

    def cut_block(some: Column) -> Column:
        first = F.get(some, 0)["a"]
        part = F.substring(source, first + 1, F.get(some, F.size(some) - 1)["b"] - first)
        return _let(part, lambda t: F.transform(some, lambda p: F.substring(t, p["a"] - first + 1, p["b"] - p["a"])))

    def cut_all(of: Column) -> Column:
        last = F.floor((F.size(of) - 1) / BLOCK).cast("int")
        return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(of, b * BLOCK + 1, BLOCK)), cut_block))

    cut = F.array_join(F.concat(_let(pieces, cut_all), F.array(F.substring(source, F.array_max(ends) + 1, F.length(source)))), mark)
    new = F.when(F.col("__spans").isNull(), source).otherwise(cut)
    return joined.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
