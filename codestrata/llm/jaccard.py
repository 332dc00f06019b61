r"""Operator 7: exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles, words being ``[^\x20\x09-\x0D]+`` with A-Z in lower
case; with fewer words, the whole sequence is its one shingle; without words the set is empty and linked
with nothing. Two documents link when their sets' Jaccard similarity is 80 % or more. The links' classes are
returned, and no link between different sets is lost; equal sets are one node, so copies are never paired.

1. Corpus counts: every shingle is counted over all documents, in ranges of its hash. Three bit filters,
   sized by the number of shingles up to LEVELS, keep which are in 2, 16, 256 sets or more; they order all
   shingles from rare to frequent. A hash that shares its cell with a more frequent one only moves later in
   that order, which stays right.
2. Prefixes: two sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each. Those in one
   set only can't be shared, so a document with enough of them has no entry in any list and is done here.
3. Relations between sets: in each shingle's list, the set with the least share of unshared shingles leads.
   Each set is compared with its leaders. It then belongs to the group of its most popular similar leader,
   and is held as what it lacks of that leader and what it has besides.
4. Answer-level skipping: a pair inside a group is answered from those differences alone. Sets that link to
   their leader are in one class and are not compared; each other set is compared with blocks of the group.
5. Index-level skipping: for pairs across groups, lists are read only where they hold several groups. A list
   is held in blocks by set size and by position; its directory says which blocks it has. A set looks only
   into blocks whose sizes and positions leave room for a link, and pairs from those are tested by their own.
   Lists of more than LIST sets are cut both ways into pairs of parts, so that none is read in one task.
6. Links become classes by alternating large and small stars, written to the shared folder at each step.

Groups are cut into blocks of BLOCK by BLOCK sets, so that none is collected in one task. Null texts have
empty sets. Repeated rows are equal documents. Nodes are sets, not doc_ids: rows of one doc_id with different
texts are linked only as their texts are, and doc_ids of any size do. A null doc_id takes part and is never
the smallest. Empty tables give no rows. Other columns are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .bpe import free_name
from .common import discard, non_null_text, partitions, saved, table

PERCENT = 80
#: How many documents make a shingle frequent, and the most bits of the filter that says so: 32, 8 and 4 MB.
LEVELS = {2: 28, 16: 26, 256: 25}
BLOCK = 128
#: Sets of a list that meet in one task.
LIST = 2048
#: Blocks of a list by set size: a block's sizes are within a quarter, so a set's partners are in three of them.
SIZES = 62
#: Blocks of a list by position, in tenths of the set: a prefix ends at two tenths and a bit.
PLACES = 3
ROWS = 1024
POPULAR = 0.5


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def links(overlap, n: int, m) -> bool:
    """Whether sets of n and m elements with such an overlap link."""
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in batch["text"]]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into parts of ROWS rows, so that few texts and shingles are held at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


def set_table(rows: DataFrame) -> DataFrame:
    """doc_id, n, sid of each document. rows: doc_id, text."""

    @F.pandas_udf("n int, sid binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(len(s), shingles.set_id(s)) for s in shingles.sets([t.encode("utf-8", "replace") for t in batch])]
            yield pd.DataFrame(found, columns=["n", "sid"])

    return rows.select("doc_id", made.asNondeterministic()("text").alias("made")).select("doc_id", "made.*")


def frequency_filters(rows: DataFrame, total: int) -> list[np.ndarray]:
    """For each of LEVELS, the packed cells of the shingles in so many documents or more. total: the sets' sizes, added up."""
    buckets = 8
    while (1 << buckets) < 4 * partitions(rows.sparkSession) and buckets < 20:
        buckets += 1
    need = {level: total.bit_length() - k for k, level in enumerate(LEVELS)}
    bits_of = {level: max(buckets + 3, min(most, need[level])) for level, most in LEVELS.items()}

    def payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            found = [s for s in shingles.sets(_texts(batch)) if len(s)]
            if not found:
                continue
            every = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            every, count = every[first], np.diff(np.concatenate([first, [len(every)]]))
            edges = np.searchsorted(every, np.arange((1 << buckets) + 1, dtype=np.uint64) << np.uint64(62 - buckets))
            below = (every >> np.uint64(62 - buckets - 32)).astype(np.uint32)  # the next 32 bits
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own, times = below[edges[k] : edges[k + 1]], count[edges[k] : edges[k + 1]]
                more = times > 1  # however many of the part's documents hold a shingle, it is sent once
                out.append((k, own.tobytes(), own[more].tobytes(), (times[more] - 1).astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "payload", "more", "times"])

    def counted(batch: pd.DataFrame) -> pd.DataFrame:
        joined = lambda name: np.concatenate([np.frombuffer(p, np.uint32) for p in batch[name]])
        every = np.sort(joined("payload"))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.concatenate([first, [len(every)]]))
        every = every[first]
        np.add.at(count, np.searchsorted(every, joined("more")), joined("times"))
        out = {"bucket": [int(batch["bucket"].iloc[0])]}
        for level, cells in bits_of.items():
            bits = np.zeros(1 << (cells - buckets), bool)
            bits[every[count >= level] >> np.uint32(32 - (cells - buckets))] = True
            out[f"f{level}"] = [np.packbits(bits, bitorder="little").tobytes()]
        return pd.DataFrame(out)

    schema = ", ".join(["bucket int", *(f"f{level} binary" for level in LEVELS)])
    sent = rows.select("text").mapInPandas(payloads, "bucket int, payload binary, more binary, times binary")
    filters = [np.zeros(1 << (cells - 3), np.uint8) for cells in bits_of.values()]
    for row in sent.groupBy("bucket").applyInPandas(counted, schema).collect():  # at most 44 MB, by LEVELS
        for f, level in zip(filters, LEVELS):
            width = len(f) >> buckets
            f[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row[f"f{level}"], np.uint8)
    return filters


def _in(shingle: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cell = shingle >> np.uint64(62 - (8 * len(bits)).bit_length() + 1)
    return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def active_sets(rows: DataFrame, filters: list[np.ndarray] | Broadcast) -> DataFrame:
    """The sets with an entry in some list: sid, n, n0 (how many shingles are in one set only) and the
    shingles from rare to frequent, those n0 first."""
    shared = filters if isinstance(filters, Broadcast) else rows.sparkSession.sparkContext.broadcast(filters)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two, *higher = shared.value
        for batch in _parts(batches):
            found: dict[bytes, tuple] = {}
            for s in shingles.sets(_texts(batch)):
                n = len(s)
                if not n:
                    continue
                shared_by_two = _in(s, two)
                n0 = n - int(shared_by_two.sum())
                if n0 >= prefix_length(n):
                    continue
                level = shared_by_two.astype(np.uint8)
                for bits in higher:  # their cells are wider: they tell nothing of shingles that are in one set only
                    level += shared_by_two & _in(s, bits)
                ordered = s[np.argsort(level, kind="stable")]  # ascending by hash within a level
                found[shingles.set_id(s)] = (n, n0, ordered.astype("<u8").tobytes())
            if found:
                yield pd.DataFrame([(k, *v) for k, v in found.items()], columns=["sid", "n", "n0", "tokens"])

    return rows.select("text").mapInPandas(rows_of, "sid binary, n int, n0 int, tokens binary").dropDuplicates(["sid"])


def list_entries(active: DataFrame) -> DataFrame:
    """token, sid, n, pos, alone: the entries of the shingles' lists."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, n0 = batch["n"].to_numpy(), batch["n0"].to_numpy()
            p = np.array([prefix_length(int(k)) for k in n])
            size = p - n0
            tokens = [np.frombuffer(t, "<u8")[a:b] for t, a, b in zip(batch["tokens"], n0, p)]
            who = np.repeat(np.arange(len(batch)), size)
            pos = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + n0[who]
            yield pd.DataFrame({"token": np.concatenate(tokens).astype(np.int64), "sid": batch["sid"].to_numpy()[who], "n": n[who], "pos": pos, "alone": (n0 / n)[who]})

    return active.mapInPandas(rows_of, "token long, sid binary, n int, pos int, alone double")


def _with_tokens(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """pairs of sids a, b with both sets."""
    side = lambda x: active.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("n0").alias(f"z{x}"), F.col("tokens").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def compare_with_leaders(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """For pairs of a set a and a leader b: sid, leader, n, j, linked, and the set as its differences:
    has (bits of the leader's shingles that it has) and besides (its other shingles that more sets have)."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, j, linked, has, besides = [], [], [], [], []
            for na, nb, za, ta, tb in zip(batch["na"], batch["nb"], batch["za"], batch["ta"], batch["tb"]):
                mine, lead = np.frombuffer(ta, "<u8"), np.sort(np.frombuffer(tb, "<u8"))
                at = np.minimum(np.searchsorted(lead, mine), len(lead) - 1)
                common = lead[at] == mine
                bits = np.zeros(len(lead), bool)
                bits[at[common]] = True
                overlap = int(common.sum())
                n.append(na)
                j.append(overlap / (na + nb - overlap))
                linked.append(bool(links(overlap, na, nb)))
                has.append(np.packbits(bits).tobytes())
                besides.append(mine[za:][~common[za:]].tobytes())
            yield pd.DataFrame({"sid": batch["a"], "leader": batch["b"], "n": n, "j": j, "linked": linked, "has": has, "besides": besides})

    schema = "sid binary, leader binary, n int, j double, linked boolean, has binary, besides binary"
    return _with_tokens(pairs, active).mapInPandas(rows_of, schema)


def verified(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """The pairs of sids a, b that link."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [links(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)), n, m) for x, y, n, m in zip(batch["ta"], batch["tb"], batch["na"], batch["nb"])]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return _with_tokens(pairs, active).mapInPandas(rows_of, "a binary, b binary")


def group_links(members: pd.DataFrame, asked: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of one group's sets: each asked set against all members, from their
    differences to the leader alone. At most one link for two classes."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    sids, n, tied = members["sid"].to_numpy(), members["n"].to_numpy(np.int64), members["linked"].to_numpy(bool)
    has = np.stack([np.frombuffer(x, np.uint8) for x in members["has"]])
    own = [np.frombuffer(x, "<u8") for x in members["besides"]]
    tokens, holder = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    found = []
    first_tied: bytes | None = None
    for sid, m, mine, extra in zip(asked["sid"], asked["n"], asked["has"], asked["besides"]):
        overlap = np.bitwise_count(has & np.frombuffer(mine, np.uint8)).sum(axis=1, dtype=np.int64)
        extra = np.frombuffer(extra, "<u8")
        a, b = np.searchsorted(tokens, extra), np.searchsorted(tokens, extra, side="right")
        for lo, hi in zip(a[b > a], b[b > a]):
            overlap[holder[lo:hi]] += 1
        near = np.flatnonzero(links(overlap, m, n))
        together = near[tied[near]]
        for k in [*together[:1], *near[~tied[near]]]:
            other = sids[k]
            if other == sid:
                continue
            if tied[k]:  # linked members are one class already, through their leader
                first_tied = first_tied or other
                mark = first_tied
            else:
                mark = other
            x, y = find(sid), find(mark)
            if x != y:
                root[x] = y
                found.append((sid, other))
    return found


def inside_groups(groups: DataFrame) -> DataFrame:
    """a, b: links between sets of one group that don't both link to the leader. groups: as compare_with_leaders."""
    size = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("linked")).alias("open")).where("open > 0 AND size > 1")
    parts = size.select("leader", F.ceil(F.col("size") / BLOCK).alias("cs"), F.ceil(F.col("open") / BLOCK).alias("ks"))
    rows = groups.join(parts, "leader")
    place = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["leader", "sid", "n", "linked", "has", "besides"]
    members = rows.select(*cols, place("cs", 1).alias("c"), upto("ks").alias("k"))
    asked = rows.where(~F.col("linked")).select(*[F.col(c).alias(c) for c in cols], place("ks", 2).alias("k"), upto("cs").alias("c"))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = group_links(left, right) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"])

    key = ["leader", "c", "k"]
    return members.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(one, "a binary, b binary")


def _size_block(n: Column) -> Column:
    """Which of SIZES blocks holds sets of n shingles: sizes of a block differ by less than a quarter, but in the last."""
    return F.least(F.floor(F.log(n.cast("double")) / float(np.log(1.25)) + 1e-9), F.lit(SIZES - 1)).cast("int")


def _place_block(pos: Column, n: Column) -> Column:
    return F.least(F.floor(10 * pos / n), F.lit(PLACES - 1)).cast("int")


def _room(size: Column, place: Column, n: Column, pos: Column) -> Column:
    """Whether any set of a block of a list could link to a set of n shingles that has the list's one at pos."""
    low = F.floor(F.pow(F.lit(1.25), size) * (1 - 1e-9))
    high = F.when(size < SIZES - 1, F.ceil(F.pow(F.lit(1.25), size + 1) * (1 + 1e-9))).otherwise(F.lit(2.0**40)).cast("long")
    last = F.when(place < PLACES - 1, F.ceil((place + 1) * high / 10)).otherwise(high)
    most = F.least(pos, last) + 1 + F.least(n - pos - 1, high - F.floor(place * low / 10))
    return (100 * n >= PERCENT * low) & (100 * high >= PERCENT * n) & (most >= F.floor(PERCENT * (n + low) / (100 + PERCENT)))


def across_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: pairs of sets of different groups that could link, by set sizes and positions in their lists."""
    placed = entries.join(groups.select("sid", "leader"), "sid", "left").withColumn("g", F.coalesce("leader", "sid")).drop("leader")
    placed = placed.withColumns({c: F.col(c).cast("long") for c in ("n", "pos")}).withColumn("size", _size_block(F.col("n"))).withColumn("place", _place_block(F.col("pos"), F.col("n")))
    one = F.lit(1).cast("long")
    blocks = [f"blocks{k}" for k in range(PLACES)]  # the directory of a list: a bit for each block that holds sets
    has = [F.bit_or(F.when(F.col("place") == k, F.call_function("shiftleft", one, F.col("size"))).otherwise(0)).alias(c) for k, c in enumerate(blocks)]
    held = placed.groupBy("token", "g").agg(F.count(one).alias("c"), *has).groupBy("token")
    held = held.agg(F.max(F.struct("c", "g")).alias("most"), F.sum("c").alias("all"), F.count(one).alias("gs"), *[F.bit_or(c).alias(c) for c in blocks]).where("gs > 1")
    parts = lambda n: F.ceil(n / LIST).cast("int")
    live = placed.join(held.select("token", F.col("most.g").alias("most"), parts(F.col("all") - F.col("most.c")).alias("is"), parts(F.col("all")).alias("js"), *blocks), "token").drop("alone")
    part = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a list's largest group needs no pairs of its own: only sets outside it look for partners
    near = F.sequence(F.greatest(F.col("size") - 1, F.lit(0)), F.least(F.col("size") + 1, F.lit(SIZES - 1)))

    def partners(k: int) -> Column:
        """The list's blocks of place k that leave room for a link."""
        there = lambda size: F.call_function("shiftright", F.col(blocks[k]), size).bitwiseAND(one) == 1
        good = F.filter(near, lambda size: there(size) & _room(size, F.lit(k), F.col("n"), F.col("pos")))
        return F.transform(good, lambda size: F.struct(size.alias("size"), F.lit(k).alias("place")))

    asked = [partners(k) for k in range(PLACES)]
    left = live.where("g <> most").withColumn("i", part("is", 3)).withColumn("block", F.explode(F.concat(*asked))).withColumn("j", upto("js"))
    left = left.select("token", "block.size", "block.place", "i", "j", *[F.col(c).alias(f"{c}1") for c in ("sid", "n", "pos", "g")])
    right = live.withColumn("j", part("js", 4)).withColumn("i", upto("is"))
    right = right.select("token", "size", "place", "i", "j", *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "pos", "g")], (F.col("g") == F.col("most")).alias("large"))
    need = F.ceil(PERCENT * (F.col("n1") + F.col("n2")) / (100 + PERCENT))
    most = F.least("pos1", "pos2") + 1 + F.least(F.col("n1") - F.col("pos1") - 1, F.col("n2") - F.col("pos2") - 1)
    once = F.col("large") | (F.col("sid1") < F.col("sid2"))
    fits = (100 * F.col("n1") >= PERCENT * F.col("n2")) & (100 * F.col("n2") >= PERCENT * F.col("n1")) & (most >= need)
    new = (F.col("g1") != F.col("g2")) & (F.col("g1") != F.col("sid2")) & (F.col("g2") != F.col("sid1"))
    met = left.join(right, ["token", "size", "place", "i", "j"]).where(once & new & fits)
    return met.select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges u, v, by alternating large and small stars.

    Each step moves edges to smaller nodes until all are stars, so it ends without a limit. A step reads what the
    one before has written, and a digest of its edges, taken while they are written, tells whether it changed any.
    """

    def written(made: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        digest = F.xxhash64("u", "v")
        found = saved(made.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("x"), F.bit_xor(F.xxhash64(digest, F.lit(1))).alias("y")), "edges")
        return found, (seen.get["n"], seen.get["x"], seen.get["y"])

    edges, state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        before, old = state, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of each join are plain exchanges, and a hub's rows can be split
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        small_least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_least, "u").select(F.col("v").alias("x"), "m", "u")
        edges, state = written(small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(old, least, large, small_least)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def linked_sets(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: links between different sets that join each class. rows: doc_id, text; sets: their set_table.

    Every step is written, so that no plan holds another's.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    filters = rows.sparkSession.sparkContext.broadcast(frequency_filters(rows, total))
    active = saved(active_sets(rows, filters), "active-sets")
    filters.destroy()
    entries = saved(list_entries(active), "entries")
    lead = entries.groupBy("token").agg(F.min(F.struct("alone", "sid")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("lead.sid").alias("b"))
    stars = saved(entries.join(lead, "token").where(F.col("sid") != F.col("b")).select(F.col("sid").alias("a"), "b").distinct(), "leaders")
    compared = saved(compare_with_leaders(stars, active), "stars")
    fame = compared.where(F.col("j") >= POPULAR).groupBy("leader").agg(F.count(F.lit(1)).alias("fame"))
    whole = F.struct("leader", "n", "linked", "has", "besides")
    order = F.struct(F.col("j") >= POPULAR, F.coalesce("fame", F.lit(0)), "j", "leader")
    groups = saved(compared.join(fame, "leader", "left").groupBy("sid").agg(F.max_by(whole, order).alias("g")).select("sid", "g.*"), "groups")
    found = saved(compared.where("linked").select(F.col("sid").alias("a"), F.col("leader").alias("b")), "linked")
    discard(stars, compared)
    inside = saved(inside_groups(groups), "inside")
    pairs = saved(across_groups(entries, groups), "pairs")
    discard(entries, groups)
    across = saved(verified(pairs, active), "across")
    discard(pairs, active)
    links = saved(found.unionByName(inside).unionByName(across), "links")
    discard(found, inside, across)
    return links


def _classes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: doc_id, n, sid; and the set that names its class, and the smallest doc_id in that (null without one)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), non_null_text(f"`{text}`").alias("text"))
    sets = saved(set_table(rows), "sets")
    links = linked_sets(sets, rows)
    component = connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(links)
    nodes = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    # written first, so that the joins' sides are plain exchanges, whose large partitions Spark can split
    labelled = saved(nodes.join(component.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("class")), "classes")
    least = labelled.groupBy("class").agg(F.min("least").alias("first"))
    return sets.join(saved(labelled.select("sid", "class").join(least, "class"), "classes"), "sid", "left")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key as doc_id, n_shingles, and component_id, the smallest doc_id of its class."""
    found = _classes(docs, text, key)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def _set_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles.set_id(s) if len(s) else None for s in shingles.sets([t.encode("utf-8", "replace") for t in batch])], dtype=object)


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id; of its equal rows one stays.

    Where several texts of the class have that doc_id, the one with the least set id stays. Rows without words are
    linked with nothing and stay, and so do rows without doc_id, which no decision can name.
    """
    found = saved(_classes(docs, text, key).where("doc_id IS NOT NULL").select("doc_id", "sid", "n", "class"), "decisions")
    first = found.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "sid")).alias("f")).select("f.doc_id", "f.sid")
    often = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    key_is = F.col(f"`{key}`").cast("long")
    names = docs.columns
    stay, mixed = free_name(names, "stay"), free_name(names, "mixed")
    alone = first.select("doc_id").unionByName(found.where("n = 0").select("doc_id")).distinct().join(often, "doc_id", "left_anti").select(F.col("doc_id").alias(stay))
    kept = docs.join(alone, key_is == F.col(stay), "left_semi").unionByName(docs.where(key_is.isNull()))
    if often.isEmpty():  # no doc_id has several rows: nothing to tell apart
        return kept
    sid = free_name(names, "sid")
    several = docs.join(often.select(F.col("doc_id").alias(mixed)), key_is == F.col(mixed), "left_semi").withColumn(sid, F.pandas_udf(_set_ids, "binary")(non_null_text(f"`{text}`")))
    several = saved(several, "repeated")
    wanted = first.select(F.col("doc_id").alias(stay), F.col("sid").alias(mixed))
    chosen = several.join(wanted, (key_is == F.col(stay)) & (F.col(f"`{sid}`") == F.col(mixed)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    value = F.col(f"`{text}`")
    chosen = chosen.groupBy(key_is.alias(stay), F.col(f"`{sid}`").alias(mixed)).agg(F.min_by(whole, F.struct(F.length(value), F.xxhash64(value))).alias(sid))
    return kept.unionByName(chosen.select(*[F.col(f"`{sid}`.`{c}`").alias(c) for c in names])).unionByName(several.where(F.col(f"`{sid}`").isNull()).drop(sid))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def _sql(documents: str = "documents") -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM {documents}
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.x AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(x) AS x FROM r GROUP BY doc_id) c USING (doc_id)
"""


OP7_SQL = _sql()
