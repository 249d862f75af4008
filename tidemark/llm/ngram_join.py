"""Exact Jaccard join on word shingles, filtered under several token orders, and the groups it links.

A token is the 64-bit hash of a shingle of five words, and equal token sets form one class (that the texts' sets agree
under a second hash of their words is checked). Two sets of sizes m and n
with a Jaccard similarity of 75 percent share a token among the first n - ceil(0.75 n) + 1 of each, in any order of all
tokens; that holds under every order at once, so a pair must pass all filters:

- the first order puts tokens that are frequent in the corpus last and the others by hash; its prefixes are the index;
- under two further orders (by other hashes) every set keeps a sketch of its prefix, fingerprints of these tokens. A
  candidate pair's prefixes must meet under each of these orders too, before its texts move.

What the orders leave must also pass a bound on its intersection: every set keeps a few counts of its
tokens by hash bucket, and two sets share at most the sum of the smaller counts.

Pairs within a posting list are not all made. First each list links its members to a leader near their size. Where
verified links leave a list in more than one connected piece, the pairs between pieces are candidates of a second and
last round, where sizes and the tokens that either set can share allow a link: pairs inside a piece can't change any
component, so no link that matters is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, discard, small_batches, text_bytes, written
from .components import components
from .hashing import mix, shingle_sets, words

SHINGLE = 5
#: Similarity in percent.
THRESHOLD = 75
#: Tokens that the first order knows as frequent: a bound on what is sent to every worker (16 bytes each).
FREQUENT = 1 << 20
#: Documents of a chunk that must share a token for it to be counted, and tokens in a chunk.
CHUNK_LEAST, CHUNK_TOKENS = 2, 3_000_000
#: Members that are verified against one copy of their leader's text.
SALT_ROWS = 256
#: Documents that a token must be seen in to count as shared by many.
COMMON = 8
#: Members of a list that one task reads, about: lists of more frequent tokens are dealt out by class as well.
LIST_ROWS = 100_000
#: Tokens of a prefix up to which fingerprints have 2 bytes, beyond that 4.
SHORT_PREFIX = 128
#: Members from which on a list's pairs are made once for all the lists that hold them.
LONG_LIST = 64
_ORDERS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def prefix_size(n: int, threshold: int = THRESHOLD) -> int:
    """Tokens of a set of n that must hold one of any similar set."""
    return n - (threshold * n + 99) // 100 + 1


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if min(len(x), len(y)) * 100 < threshold * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= threshold * (len(x) + len(y) - shared)


def sketch(s: np.ndarray, threshold: int) -> bytes:
    """Sorted fingerprints of a set's prefix under each further order, one order after the other."""
    p = prefix_size(len(s), threshold)
    kind = "<u2" if p <= SHORT_PREFIX else "<u4"
    return b"".join(np.sort(np.partition(mix(s ^ seed), p - 1)[:p].astype(kind)).tobytes() for seed in _ORDERS)


def prefixes_meet(x: bytes, nx: int, y: bytes, ny: int, threshold: int) -> bool:
    """False only if sets with these sketches share no token of their prefixes under one of the further orders."""
    both = []
    for held, n in ((x, nx), (y, ny)):
        p = prefix_size(n, threshold)
        both.append(np.frombuffer(held, "<u2" if p <= SHORT_PREFIX else "<u4").reshape(len(_ORDERS), p))
    if both[0].dtype != both[1].dtype:
        both = [b.astype("<u2") for b in both]
    return all(np.isin(a, b).any() for a, b in zip(*both, strict=True))


def signature(s: np.ndarray) -> bytes:
    """Tokens of a set in each of about a quarter as many buckets, a byte for each (255: as many or more)."""
    bits = max(4, (len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_be_similar(x: bytes, nx: int, y: bytes, ny: int, threshold: int) -> bool:
    """False only if sets of these sizes and signatures can't be similar."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if p.max(initial=0) == 255 or q.max(initial=0) == 255:
        return True
    p, q = p.astype(np.int32), q.astype(np.int32)
    if len(p) < len(q):
        q = q.reshape(len(p), -1).sum(axis=1)
    elif len(q) < len(p):
        p = p.reshape(len(q), -1).sum(axis=1)
    shared = int(np.minimum(p, q).sum())
    return 100 * shared >= threshold * (nx + ny - shared)


def _sets(texts: list[bytes | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b in chunked(texts):
        for i, s in enumerate(shingle_sets(words(texts[a:b], lower=True), size)):
            yield a + i, s


def _two_sets(texts: list[bytes | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set by the first and by the second hash of words."""
    for a, b in chunked(texts):
        w = words(texts[a:b], lower=True)
        yield from zip(shingle_sets(w, size), shingle_sets(w.second(), size), strict=True)


def _class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


_PROFILE = "doc_id long, text_key long, n int, cls long, digest binary, sig binary, sketch binary, token long, seen long"


def _profiles(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """Per document its set's size, class, digest, signature and sketch; and per chunk of documents the tokens that several share."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("sketch", pa.binary()), ("token", pa.int64()), ("seen", pa.int64())])
        held: list[np.ndarray] = []
        tokens = 0

        def shared() -> pa.RecordBatch | None:
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            ok = seen >= CHUNK_LEAST
            none = pa.nulls(int(ok.sum()))
            columns = [none.cast(f.type) for f in list(schema)[:7]] + [pa.array(token[ok].view(np.int64)), pa.array(seen[ok].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, schema=schema) if ok.any() else None

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), text_bytes(batch.column(2))
            n, cls, digest, sig, sketches = [], [], [], [], []
            for s, other in _two_sets(texts, size):
                n.append(len(s))
                cls.append(_class_id(s) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
                sketches.append(sketch(s, threshold) if len(s) else None)
                digest.append(hashlib.blake2b(other.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None)
                if tokens + len(s) > CHUNK_TOKENS and held:
                    if (found := shared()) is not None:
                        yield found
                    held, tokens = [], 0
                held.append(s)
                tokens += len(s)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(sketches, pa.binary()), none, none], schema=schema)
        if held and (found := shared()) is not None:
            yield found

    return rows.mapInArrow(emit, _PROFILE)


def _postings(rows: DataFrame, size: int, threshold: int, frequent: np.ndarray, seen: np.ndarray) -> DataFrame:
    """token, salt, cls, n, rare, own for the prefix of each set under the first order.

    frequent: tokens known to be shared, the most frequent last, and how many documents each was seen in. rare counts a
    set's tokens that aren't shared by many: of near copies, the one that the others were made from has the fewest. own
    tells whether the token is one of these. salt is 0, or for very long lists the part (from 1) that a class is in.
    """
    order, common = np.argsort(frequent), int(np.searchsorted(seen, COMMON))
    parts = np.where(seen > LIST_ROWS, seen // LIST_ROWS + 1, 0).astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast((frequent[order], order, parts if parts.any() else None))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, parts = shared.value
        done: set[int] = set()  # classes sent by this task; may be forgotten without harm
        for batch in batches:
            token, salt, cls, n, rare, own = [], [], [], [], [], []
            for _, s in _sets(text_bytes(batch.column(0)), size):
                c = _class_id(s)
                if not len(s) or c in done:
                    continue
                done.add(c)
                p = prefix_size(len(s), threshold)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    ranks = place[at[often]]
                    first, lone = s[~often][:p], len(s) - int((ranks >= common).sum())
                    late = np.argsort(ranks)[: p - len(first)] if len(first) < p else ranks[:0]
                    salts = np.zeros(len(first) + len(late), np.int32)
                    if parts is not None and len(late):
                        of = parts[ranks[late]].astype(np.int64)
                        salts[len(first) :] = np.where(of > 0, c % np.maximum(of, 1) + 1, 0)
                    first = np.concatenate((first, s[often][late]))
                else:
                    first, lone, salts = s[:p], len(s), np.zeros(min(p, len(s)), np.int32)
                salt.append(salts)
                token.append(first)
                cls.append(np.full(len(first), c, np.int64))
                n.append(np.full(len(first), len(s), np.int32))
                rare.append(np.full(len(first), lone, np.int32))
                own.append(np.arange(len(first)) < lone)
            if len(done) > 200_000:
                done.clear()
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(salt)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(n)), pa.array(np.concatenate(rare)), pa.array(np.concatenate(own))], ["token", "salt", "cls", "n", "rare", "own"])

    return rows.select("text").mapInArrow(emit, _POSTING)


_POSTING = "token long, salt int, cls long, n int, rare int, own boolean"


def _leaders(postings: DataFrame, threshold: int) -> DataFrame:
    """Lists as rows: each member and the leader it may be similar to (itself where it leads).

    Members come with the least rare first, so leaders are central to their near copies. A member follows the first
    leader whose size allows a link, and leads if there is none: a list has as many leaders as it has scales of size.
    Lists of one class give nothing.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = last = None  # of the list at hand; a token and its salt
        leaders: list[tuple[int, int]] = []
        first: tuple | None = None  # a list's first member, held until a second one comes
        for batch in batches:
            t, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Most lists have one member; leave them out at once, but not parts of a list.
            alone = salt == 0
            if len(t) > 1:
                same = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
                alone[1:] &= ~same
                alone[:-1] &= ~same
            alone[0] = alone[-1] = False  # their lists may go on in other batches
            out: list[tuple] = []
            for row in zip(*(c.filter(pa.array(~alone)).to_pylist() for c in batch.columns), strict=True):
                x, cls, size = row[:2], row[2], row[3]
                if x != token:
                    if first is not None and first[1]:
                        out.append((*first, first[2]))
                    token, leaders, last, first = x, [(cls, size)], cls, row
                    continue
                if cls == last:
                    continue
                last = cls
                if first is not None:
                    out.append((*first, first[2]))
                    first = None
                lead = next((a for a, m in leaders if 100 * min(m, size) >= threshold * max(m, size)), None)
                if lead is None:
                    leaders.append((cls, size))
                    lead = cls
                out.append((*row, lead))
            if out:
                yield rows_of(out)
        if first is not None and first[1]:
            yield rows_of([(*first, first[2])])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["token", "salt", "cls", "n", "rare", "own", "leader"])

    central = (1000 * F.col("rare") / F.col("n")).cast("int")
    return postings.repartition("token", "salt").sortWithinPartitions("token", "salt", central, "n", "cls").mapInArrow(emit, _POSTING + ", leader long")


def _possible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct pairs a, b whose prefixes meet under every order, and whose signatures leave them a chance."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns[2:])
            ok = [prefixes_meet(p, nx, q, ny, threshold) and may_be_similar(x, nx, y, ny, threshold) for p, x, nx, q, y, ny in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("p"), F.col("sig").alias("x"), F.col("n").alias("nx"))
    y = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("q"), F.col("sig").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "p", "x", "nx", "q", "y", "ny")
    return written(both.mapInArrow(emit, "a long, b long"), "pairs")


def _texts(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, text: one document's text for each class that a pair names."""
    named = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = classes.join(named, "cls").select("cls", "doc_id", "text_key")
    return written(rows.join(chosen, ["doc_id", "text_key"]).select("cls", "text").dropDuplicates(["cls"]), "texts")


def _links(pairs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the distinct pairs a, b whose texts' sets are similar; the pairs and their texts are deleted after it."""
    texts = _texts(rows, classes, pairs)
    out = written(_verified(pairs, texts, size, threshold), "links")
    discard(pairs, texts)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the distinct pairs a, b whose texts' sets are similar. Members come to copies of their leader's text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, own = None, None
        for batch in batches:
            leaders, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, s in _sets(text_bytes(batch.column(2)), size):
                if members[i] is None:
                    a, own = leaders[i], s
                elif leaders[i] == a and similar(own, s, threshold):
                    out.append((a, members[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b"])

    salts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("salts"))
    leaders = salts.join(texts.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    members = members.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")
    both = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return both.select("a", "b", "text").mapInArrow(emit, "a long, b long")


def _across(x: DataFrame, threshold: int, also=None) -> DataFrame:
    """Pairs a, b of classes in one list, but in two pieces, that sizes and shareable tokens allow.

    Classes only meet within bands of sizes: similar sets are in one band, or in two neighbouring ones.
    """
    band = F.floor(F.log(F.col("n")) / math.log(1.01 * 100 / threshold)).cast("int")
    y = x.withColumn("band", band).withColumnsRenamed({c: f"{c}2" for c in x.columns})
    x = x.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    least = F.when(F.col("covered") & F.col("covered2"), F.least("room", "room2")).otherwise(F.least("n", "n2"))
    on = (F.col("token") == F.col("token2")) & (x["band"] == y["band"]) & (F.col("piece") != F.col("piece2")) & (F.col("cls") < F.col("cls2")) & (100 * least >= threshold * (F.col("n") + F.col("n2") - least))
    return x.join(y, on if also is None else on & also).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))


def similarity_classes(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, text_key, n_shingles, cls) and the verified links (a, b) between classes.

    Links join every two classes that similar texts connect, not every similar pair: see the module's text. Documents
    without words have no class. Rows with a null id take no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    profile = written(_profiles(rows.select("doc_id", "text_key", "text"), size, threshold), "profiles")
    members = profile.where("doc_id is not null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "cls", "digest")
    clash = members.groupBy("cls").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    if clash.count():  # about one in 10**9 corpora of 10**5 documents; never passed over in silence
        raise ValueError("two token sets share a 64-bit class id; change the hash's digest")
    counts = profile.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counts.orderBy(F.desc("seen"), "token").limit(FREQUENT).select("token", "seen").toArrow()
    token, seen = (top.column(c).to_numpy() for c in ("token", "seen"))
    order = np.lexsort((token, seen))
    token, seen = token[order].view(np.uint64), seen[order]

    lists = written(_leaders(_postings(rows, size, threshold, token, seen), threshold), "lists")
    pairs = lists.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    if len(seen) and seen[-1] > LIST_ROWS:  # the leaders of a long list's parts make a list of their own
        above = lists.where("salt > 0 and cls = leader").withColumn("salt", F.lit(0)).drop("leader")
        pairs = pairs.unionAll(_leaders(above, threshold).where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")))
    stars = written(pairs.distinct(), "stars")
    one = profile.where("cls is not null").groupBy("cls").agg(F.min_by(F.struct("doc_id", "text_key", "n", "sig", "sketch"), F.struct("doc_id", "text_key")).alias("d"))
    classes = written(one.select("cls", "d.*"), "classes")
    first = _links(_possible(stars, classes, threshold), rows, classes, size, threshold)

    known = components(first).withColumnRenamed("node", "cls")
    # Of a set that is `covered`, all tokens that aren't shared by many are in its prefix. Two such sets share at most
    # their other tokens, unless they meet in a list of one of these; and there at most those that lists hold, too.
    met = lists.where("own").groupBy("cls").agg(F.count(F.lit(1)).alias("met"))
    room = F.col("n") - F.col("rare") + F.when(F.col("own"), F.coalesce("met", F.lit(0))).otherwise(0)
    covered = F.col("rare") <= F.col("n") - F.floor((threshold * F.col("n") + 99) / 100) + 1
    placed = lists.join(known, "cls", "left").join(met, "cls", "left")
    placed = placed.select("token", "own", "cls", "n", F.when(covered, room).otherwise(F.col("n")).alias("room"), covered.alias("covered"), F.coalesce("component", "cls").alias("piece"))
    size_of = F.count(F.lit(1)) >= LONG_LIST
    apart = placed.groupBy("token").agg(F.min("piece").alias("x"), F.max("piece").alias("y"), size_of.alias("long")).where("x <> y").select("token", "long")
    x = written(placed.join(apart, "token"), "apart")
    discard(lists)
    # Similar sets share many long lists; the least token of these (of either kind) makes the pair.
    held = x.where("long").groupBy("cls", "own").agg(F.collect_set("token").alias("tokens"))  # a part of a prefix
    long = x.where("long").join(held, ["cls", "own"])
    once = F.array_min(F.array_intersect("tokens", "tokens2")) == F.col("token")
    more = _across(x.where("not long"), threshold).unionByName(_across(long, threshold, once)).distinct()
    tried = stars.union(stars.select("b", "a"))
    likely = _possible(more.join(tried, ["a", "b"], "left_anti"), classes, threshold)
    discard(x, stars)
    second = _links(likely, rows, classes, size, threshold)
    discard(classes)
    return members, first.unionByName(second)


def ngram_components(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest id that links reach) for every row with an id.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with fewer words than a shingle has
    one token, its whole word sequence; null texts and texts without words have none and link with nothing. Equal sets
    are one class, whatever their number; rows that share an id belong to the groups of each of their texts. An empty
    table gives an empty result.
    """
    members, links = similarity_classes(docs, size, threshold, id_col, text_col)
    # Rows of one id connect their classes as well.
    ids = members.where("cls is not null").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    several = ids.where("low <> high").join(members, "doc_id").where("cls is not null").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    groups = components(links.unionByName(several)).withColumnRenamed("node", "cls")
    held = members.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    held = written(held.select("doc_id", "text_key", "n_shingles", "component"), "members")
    # Written, so that both sides of the join are plain shuffles and Spark can split a component that many rows share.
    low = written(held.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "components")
    return held.join(low, "component", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, that stand for their group: the one with the smallest id.

    Of rows that share this id, and of repeated rows, one stays. Rows with a null id stay, as do texts without words.
    """
    found = ngram_components(docs, size, threshold, id_col, text_col)
    chosen = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select(F.col("d.doc_id").alias("__id"), F.col("d.text_key").alias("__key"))
    # The table's own columns go through in one struct, whatever their names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__key"))
    kept = keyed.where("__id is not null").join(chosen, ["__id", "__key"]).dropDuplicates(["__id", "__key"])
    return kept.select("row.*").unionAll(docs.where(F.col(id_col).isNull()))
