"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of 5-word shingles and a signature of K min-hash coordinates. Documents of one and
   the same set are one class, represented by its smallest id; only classes go on.
2. Each class is posted under its (coordinate, value) pairs. A pair's document frequency orders them from rare to
   frequent, and only the prefix that a partner with T collisions cannot miss is posted: of c shared pairs the
   c - T + 1 rarest; a class with fewer than T shared pairs is posted nowhere. Common passages are frequent, so
   they fall behind the prefix.
3. Members of a posting list are counted against each other by merging: entries of K / 2 coordinates are sorted by
   (coordinate, value) and every two members of an entry's run collide once more. The lists of the other coordinates
   are skipped over: they are only looked up for pairs that can still reach T. What leaves the list are stars, at most
   one edge a member.
4. Connected components of these edges are candidate groups. A group's whole texts meet, and their full shingle sets
   are merged in the same way, so that every pair's intersection is exact; again stars leave the task.
5. Components of confirmed links give the result. No pair is sampled, capped or dropped: the only loss is a linked
   pair with fewer than T of K collisions (K = 64, T = 34: less than 1 in 10,000 at similarity 0.75, and falling).

Lists and groups of more than a block are dealt out in two passes. First in chunks, each with the same few pivots of
its key: linear, and it settles what is linked through members of one chunk or a pivot. Then only members outside the
key's largest component meet the others, in pairs of blocks; members of one component are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import drop, runs, table, text_bytes
from claimlake.llm.components import components, star_batch
from claimlake.llm.textkit import MinHash, chunks, mix, shingle_sets

#: Signature coordinates, and the collisions that make a candidate.
K, T = 64, 34
#: Members of a posting list; members and shingles of a candidate group: what a chunk holds on average.
LIST_BLOCK, GROUP_MEMBERS, GROUP_BLOCK = 128, 128, 500_000
#: Members of a list or group that every chunk of it holds, on average.
PIVOTS = 8
#: Up to so many candidate rows (two longs and four ints each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Lists and groups of up to so many members are merged many at once.
SMALL = 16


def _sketch(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(k)
    for batch in batches:
        for i, j, data, offsets in chunks(batch["b"]):
            sets = shingle_sets(data, offsets, size)
            full = [s for s in sets if len(s)]
            tokens = np.zeros((j - i, k), np.uint64)
            tokens[[r for r, s in enumerate(sets) if len(s)]] = minhash(full)
            short = (tokens & np.uint64(65535)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(tokens.view(np.int64).ravel()), k).cast(pa.list_(pa.int64())),
                ],
                names=["id", "n", "fp", "sig", "tokens"],
            )


def _lists(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted lists of (key, owner) entries: owners in order of key, and the start and length of each list."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return owner, starts, np.diff(np.append(starts, len(keys)))


def _together(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two places of one list, once; as many rounds as the longest list is long."""
    end = np.repeat(starts + lengths, lengths)
    at = np.arange(len(end)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    d = 1
    while len(at):
        inside = at + d < end
        at, end = at[inside], end[inside]
        yield at, at + d
        d += 1


def few_shared(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, number of keys that they share), i < j, from ascending owners; for short lists."""
    owner, starts, lengths = _lists(keys, owner)
    several = lengths > 1
    base = int(owner.max()) + 1 if len(owner) else 1
    codes = [owner[a] * base + owner[b] for a, b in _together(starts[several], lengths[several])]
    code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
    return code // base, code % base, count


def all_shared(keys: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """The same as a matrix of all members, for lists of any length; entries above the diagonal count."""
    owner, starts, lengths = _lists(keys, owner)
    count = np.zeros((m, m), np.int32)
    short = (lengths > 1) & (lengths <= SMALL)
    flat = count.reshape(-1)
    for a, b in _together(starts[short], lengths[short]):
        np.add.at(flat, owner[a] * m + owner[b], 1)
    count += int((lengths == m).sum()) if m > SMALL else 0  # what all have is not merged
    long = (lengths > SMALL) & (lengths < m)
    for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        members = owner[a : a + n]
        count[members[:, None], members] += 1
    return count


def _cuts(part: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    columns = [part[k].to_numpy() for k in keys]
    change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.diff(np.append(starts, part.num_rows))


def _alike(n: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes allow the similarity and that are not connected yet."""
    return (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (label[i] != label[j])


def collisions(sig: np.ndarray, group: np.ndarray, n: np.ndarray, label: np.ndarray, threshold: int, percent: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group, ascending, with ``threshold`` collisions. Enough coordinates are merged that a pair cannot reach
    the threshold without some collisions in them; the lists of the others are probed for the pairs that have those."""
    m, k = sig.shape
    merged = max(k // 2, k - threshold + 1)
    keys = ((group[:, None] * merged + np.arange(merged)) << 16 | sig[:, :merged]).reshape(-1)
    owner = np.repeat(np.arange(m), merged)
    if small:
        i, j, count = few_shared(keys, owner)
    else:
        matrix = all_shared(keys, owner, m)
        i, j = np.nonzero(np.triu(matrix >= threshold - (k - merged), 1))
        count = matrix[i, j]
    able = (count >= threshold - (k - merged)) & _alike(n, label, i, j, percent)
    i, j, count = i[able], j[able], count[able]
    for a in range(0, len(i), 1 << 15):
        b = slice(a, a + (1 << 15))
        count[b] += (sig[i[b], merged:] == sig[j[b], merged:]).sum(1)
    return i[count >= threshold], j[count >= threshold]


def _merge_lists(batches: Iterator[pa.RecordBatch], threshold: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of posting lists, sorted by key, to the stars of their pairs."""
    for part in runs(batches, ["token", "bi", "bj"]):
        starts, lengths = _cuts(part, ["token", "bi", "bj"])
        rep, n, label = (part[c].to_numpy() for c in ("rep", "n", "label"))
        sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(len(rep), -1).astype(np.int64)
        u, v = [], []
        few = (lengths > 1) & (lengths <= SMALL)
        if few.any():
            rows = np.flatnonzero(np.repeat(few, lengths))
            i, j = collisions(sig[rows], np.repeat(np.arange(int(few.sum())), lengths[few]), n[rows], label[rows], threshold, percent, True)
            u.append(rep[rows[i]]), v.append(rep[rows[j]])
        for a, m in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
            own = slice(a, a + m)
            i, j = collisions(sig[own], np.zeros(m, np.int64), n[own], label[own], threshold, percent, False)
            u.append(rep[a + i]), v.append(rep[a + j])
        if sum(map(len, u)):
            yield star_batch(np.concatenate(u), np.concatenate(v))


def links(sets: list[np.ndarray], group: np.ndarray, label: np.ndarray, percent: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group, ascending, with 100 * shared >= percent * union."""
    n = np.array([len(s) for s in sets])
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    if small:
        i, j, count = few_shared(mix(keys ^ mix(group.astype(np.uint64))[owner]), owner)
    else:
        matrix = all_shared(keys, owner, len(sets))
        i, j = np.nonzero(np.triu((matrix > 0) & ((100 + percent) * matrix.astype(np.int64) >= percent * (n[:, None] + n)), 1))
        count = matrix[i, j]
    ok = (100 * count >= percent * (n[i] + n[j] - count)) & (label[i] != label[j])
    return i[ok], j[ok]


def _confirm_groups(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of candidate groups, sorted by key, to the stars of their links."""
    for part in runs(batches, ["grp", "bi", "bj"]):
        starts, lengths = _cuts(part, ["grp", "bi", "bj"])
        sets = [s for _, _, data, offsets in chunks(part["b"]) for s in shingle_sets(data, offsets, size)]
        rep, label = (part[c].to_numpy() for c in ("rep", "label"))
        u, v = [], []
        few = (lengths > 1) & (lengths <= SMALL)
        if few.any():
            rows = np.flatnonzero(np.repeat(few, lengths))
            i, j = links([sets[r] for r in rows], np.repeat(np.arange(int(few.sum())), lengths[few]), label[rows], percent, True)
            u.append(rep[rows[i]]), v.append(rep[rows[j]])
        for a, m in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
            i, j = links(sets[a : a + m], np.zeros(m, np.int64), label[a : a + m], percent, False)
            u.append(rep[a + i]), v.append(rep[a + j])
        if sum(map(len, u)):
            yield star_batch(np.concatenate(u), np.concatenate(v))


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast where its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _chunked(df: DataFrame, blocks: Column, pivots: Column) -> DataFrame:
    """Adds (bi, bj): the chunk of each row among its key's ``blocks``; rows drawn as pivots are in all of them.
    ``pivots``: the share of rows that are."""
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(31), "rep"), F.lit(1 << 30)) < pivots * (1 << 30))
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    df = df.withColumn("blocks", blocks.cast("int"))
    df = df.withColumn("bi", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    return df.withColumn("bj", F.col("bi")).drop("blocks")


def _crossed(df: DataFrame, key: str, members: int, weight: str, weights: int) -> DataFrame:
    """(key, rep, label, weight) rows of keys that were dealt out in chunks -> rows with (bi, bj): members outside
    the key's largest component meet all others in pairs of blocks. Keys of one component have no rows."""
    by_label = df.groupBy(key, "label").agg(F.count("*").alias("m"), F.sum(weight).alias("s"))
    order = F.struct("m", "label")
    by_key = by_label.groupBy(key).agg(F.max_by("label", order).alias("most"), F.max("m").alias("mm"), F.max_by("s", order).alias("ms"), F.sum("m").alias("am"), F.sum("s").alias("as"))
    blocks = lambda m, s: F.greatest(F.ceil(m / members), F.ceil(s / weights)).cast("int")
    by_key = by_key.where("mm < am").select(key, "most", blocks(F.col("am") - F.col("mm"), F.col("as") - F.col("ms")).alias("rest"), blocks(F.col("mm"), F.col("ms")).alias("main"))
    df = df.join(_few(table(by_key, "keys")), key)
    outside, h = F.col("label") != F.col("most"), F.xxhash64(F.lit(37), "rep")
    own = F.when(outside, F.pmod(h, F.col("rest"))).otherwise(F.col("rest") + F.pmod(h, F.col("main"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(outside, F.col("rest") + F.col("main")).otherwise(F.col("rest")) - 1))
    df = df.withColumn("own", own).withColumn("other", other)
    return df.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("own", "other", "most", "rest", "main")


def _dealt(df: DataFrame, keys: list[str], fn: Callable) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fn, "u long, v long")


def _labelled(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the component of ``rep``, itself where it has no edge."""
    found = components(edges).withColumnRenamed("node", "rep")
    return df.join(found, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")


def _candidates(reps: DataFrame, threshold: int, percent: int, list_block: int) -> DataFrame:
    """Classes (rep, n, sig, tokens) -> edges whose components are the candidate groups."""
    tokens = reps.select("rep", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= threshold)
    prefix = table(ranked.select("rep", F.slice("t", F.lit(1), F.size("t") - threshold + 1).alias("t")), "prefix")
    posted = prefix.join(reps.select("rep", "n", "sig"), "rep").select("rep", "n", "sig", F.explode("t").alias("t")).select("rep", "n", "sig", "t.token", "t.df")
    lists = _chunked(posted, F.ceil(F.col("df") / list_block), PIVOTS / F.col("df")).withColumn("label", F.col("rep"))
    merge = partial(_merge_lists, threshold=threshold, percent=percent)
    edges = table(_dealt(lists, ["token", "bi", "bj"], merge), "candidates")
    if (prefix.agg(F.max(F.element_at("t", -1)["df"])).first()[0] or 0) > list_block:
        long = _labelled(posted.where(F.col("df") > list_block), edges)
        crossed = _crossed(long.withColumn("w", F.lit(0)), "token", list_block, "w", 1)
        edges = edges.union(table(_dealt(crossed, ["token", "bi", "bj"], merge), "crossed"))
    return edges


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = 5,
    percent: int = 75,
    k: int = K,
    threshold: int = T,
    list_block: int = LIST_BLOCK,
    group_members: int = GROUP_MEMBERS,
    group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """-> one row per row of ``docs``: id, n_shingles, component_id, kept.

    Null, empty and wordless texts have no shingles and stand alone. Texts with equal sets are linked whatever
    their signature. Rows repeated under one id are all returned, and ``kept`` holds for each that carries the
    component's id (two different texts under one id are linked through it). A row without an id links to nothing:
    component_id null, kept. A pair at exactly ``percent`` is linked; which of equal sets stands for them changes no row.
    Texts of any length are taken whole. An empty table gives no rows; other columns are not
    looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("b"))
    sketch = table(source.mapInArrow(partial(_sketch, size=size, k=k), "id long, n long, fp binary, sig binary, tokens array<long>"), "sketch")
    some = sketch.where("n > 0 and id is not null")
    reps = table(some.groupBy("n", "fp").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"), F.min_by("tokens", "id").alias("tokens")), "reps")

    groups = components(_candidates(reps, threshold, percent, list_block))
    members = table(groups.join(reps.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("rep"), F.col("component").alias("grp"), "n"), "members")
    parts = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).withColumn("blocks", F.greatest(F.ceil(F.col("m") / group_members), F.ceil(F.col("s") / group_block)))
    large = table(parts.where("blocks > 1"), "large")
    some_large = not large.isEmpty()
    large = _few(large)

    # Every row under a representative's id is looked at; its class is made of equal sets, so any of them will do
    # unless an id is repeated with other texts, whose own classes are then linked through the id below.
    def confirmed(wanted: DataFrame) -> DataFrame:
        wanted = table(wanted.select(F.col("rep").alias("id"), "grp", "bi", "bj", "label"), "wanted")
        texts = source.join(_few(wanted), "id").withColumnRenamed("id", "rep")
        found = table(_dealt(texts, ["grp", "bi", "bj"], partial(_confirm_groups, size=size, percent=percent)), "links")
        drop(wanted)
        return found

    share = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(group_block / 2 / (F.col("s") / F.col("m"))))) / F.col("m")
    first = _chunked(members.join(large, "grp", "left"), F.coalesce("blocks", F.lit(1)), F.coalesce(share, F.lit(0)))
    found = confirmed(first.withColumn("label", F.col("rep")))
    if some_large:
        rest = _labelled(members.join(large.select("grp"), "grp"), found)
        found = found.union(confirmed(_crossed(rest, "grp", 2 * group_members, "n", group_block)))

    member = some.select("id", "n", "fp").join(reps.select("n", "fp", "rep"), ["n", "fp"]).select("id", "rep")
    again = member.where("id <> rep").join(some.groupBy("id").count().where("count > 1"), "id", "left_semi")
    again = table(again.select(F.col("id").alias("u"), F.col("rep").alias("v")), "again")
    linked = components(found.union(again))
    home = member.groupBy("id").agg(F.min("rep").alias("rep")).join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    home = home.select(F.col("id").alias("home"), F.least("rep", "component").alias("component"))
    out = sketch.select("id", "n").join(home, F.col("id") == F.col("home"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
