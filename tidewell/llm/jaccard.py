"""N-gram Jaccard join by PartEnum signatures.

The feature domain (hashes of word n-grams) is cut into ``n1`` partitions, where
``n1`` is fixed by a band of set sizes. Two sets of sizes ``s`` and ``t`` with
Jaccard similarity of ``p`` or more differ in at most ``k = (s + t)(1-p)/(1+p)``
features, so they disagree in ``k`` partitions at most. A set's signature for a
partition is the hash of its projection on it; of a set's non-empty projections
only the first ``k + 1 + h`` in hash order are enumerated. Similar sets of a band
then share ``h + 1`` signatures at least, whatever the other ``k`` are: the first
``h + 1`` they have in common rank within the first ``k + 1 + h`` of both.

That needs more than ``k + h`` non-empty projections. Bands of up to FINE features
therefore have 2 ** 64 partitions, so that every feature has its own; wider bands
have as many partitions as features, of which 0.63 are used on average, and ``k + h``
is under 0.4. So ``h + 1`` single partitions shared stand for one shared subset.

A set whose size lies within the similarity of the next band is enumerated for
that band too. A set with fewer than ``h + 1`` shared signatures is dropped before
any pair is made; that rids the search of sets that only share a common passage.

Within a group of sets that share a signature no pairs are enumerated at first:
each set is compared with one hub of its group. Sets that turn out similar are
merged, and only groups that still hold several components, for sets that still
have ``h + 1`` open signatures, go into the next round with other hubs. What is
left after ``rounds`` is resolved by counting, for pairs in different components,
their shared signatures; those with ``h + 1`` are compared exactly. All decisions
are made on whole sets of 64-bit feature hashes.

Groups are told by windows over signatures, but for heavy ones, which are dealt to
many tasks: a group that holds more than HOT of one in HEAVY_SHARE different sets is
shared and hot whatever the others are, so it needn't be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.scratch import Scratch
from tidewell.llm.words import U, Slice, mix, signed, slices, windows

FINE = 256  # bands that end here or below have a partition for every feature
HUB_MEMBERS = 400  # texts that one task compares with one copy of a hub's text
HUBS = 6  # that a set is compared with in each round but the first
HOT = 64  # a group of more sets is hot
HEAVY_SHARE = 64  # one set in so many is looked at beforehand for groups that no task should hold alone
HEAVY = 100_000  # such groups at most; 8 bytes of each go with the tasks
SALTS = 256  # parts that they are dealt to


def bands() -> np.ndarray:
    """Lower ends of the size bands, each four times as wide as the one before."""
    return 4 ** np.arange(0, 16, dtype=np.int64)


def feature_sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within the text, and text bounds."""
    value, text, _ = windows(part, size)
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.int16 if part.n < 2**15 else np.int64), kind="stable")]
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(part.n + 1))


def _sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, U)
    np.cumsum(value, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def identities(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; equal sets have equal names."""
    return mix(_sums(mix(value), bounds) + np.diff(bounds).astype(U) * U(0x9E3779B97F4A7C15))


def _most_differences(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return (small + large) * (100 - percent) // (100 + percent)


def signatures(value: np.ndarray, bounds: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set: its signatures as (hash, set, least number that a similar set shares)."""
    low = bands()
    count = np.diff(bounds)
    band = np.searchsorted(low, count, "right") - 1
    most = count * 100 // percent  # size of the largest similar set
    for up in (0, 1):
        for b in np.unique(band[count > 0]):
            top = low[b + 1 + up]
            if up:
                chosen = np.flatnonzero((band == b) & (most >= low[b + 1]))
            else:
                chosen = np.flatnonzero(band == b)
            if not len(chosen):
                continue
            k = _most_differences(count[chosen], np.minimum(most[chosen], top - 1), percent)
            extra = int(low[b + up] // 4)
            bits = 64 if top <= FINE else int(np.log2(top))
            where = np.repeat(np.arange(len(chosen)), count[chosen])
            start = np.repeat(bounds[chosen] - np.concatenate([[0], np.cumsum(count[chosen])[:-1]]), count[chosen])
            v = value[np.arange(len(where)) + start]
            part = v >> U(64 - bits)
            first = np.ones(len(v), bool)
            first[1:] = (part[1:] != part[:-1]) | (where[1:] != where[:-1])
            first = np.flatnonzero(first)
            edge = np.append(first, len(v))
            sig = mix(_sums(mix(v ^ U(0x5851F42D4C957F2D)), edge) + part[first] + U(int(b + up) << 40))
            where = where[first]
            order = np.argsort(sig)
            order = order[np.argsort(where[order], kind="stable")]
            sig, where = sig[order], where[order]
            rank = np.arange(len(sig)) - np.searchsorted(where, np.arange(len(chosen)))[where]
            keep = rank < (k + 1 + extra)[where]
            yield sig[keep], chosen[where[keep]], np.full(int(keep.sum()), extra + 1, np.int32)


def _profile(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(2)):
            value, bounds = feature_sets(part, size)
            count = np.diff(bounds)
            node = pa.array(signed(identities(value, bounds)), mask=count == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(part.first, part.n) for i in (0, 1)), pa.array(count), node], ["id", "t", "n", "node"])


def _signature_rows(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: dict[int, None] = {}  # of the sets met last in this task: copies are named once
    for batch in batches:
        for part in slices(batch.column(0)):
            value, bounds = feature_sets(part, size)
            name = identities(value, bounds)
            fresh = []
            for i, x in enumerate(name.tolist()):
                if x not in seen and bounds[i + 1] > bounds[i]:
                    fresh.append(i)
                    seen[x] = None
            while len(seen) > 100_000:
                del seen[next(iter(seen))]
            if not fresh:
                continue
            pick = np.zeros(part.n, bool)
            pick[fresh] = True
            value = value[np.repeat(pick, np.diff(bounds))]
            sizes = np.where(pick, np.diff(bounds), 0)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for sig, where, need in signatures(value, bounds, percent):
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(signed(name[where])), pa.array(need)], ["sig", "node", "need"])


def _compare(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by hub, the hub's own text first; gives the similar pairs."""
    hub, hub_set = None, np.zeros(0, U)
    for batch in batches:
        hubs, nodes, own = (batch.column(i).to_pylist() for i in range(3))
        a, b = [], []
        for part in slices(batch.column(3)):
            value, bounds = feature_sets(part, size)
            name = signed(identities(value, bounds)).tolist()
            for i in range(part.n):
                row = part.first + i
                if name[i] != nodes[row]:  # another text under the same id
                    continue
                mine = value[bounds[i] : bounds[i + 1]]
                if own[row]:
                    hub, hub_set = hubs[row], mine
                elif hub == hubs[row] and len(hub_set):
                    at = np.searchsorted(hub_set, mine)
                    at[at == len(hub_set)] = 0
                    both = int(np.count_nonzero(hub_set[at] == mine))
                    if 100 * both >= percent * (len(mine) + len(hub_set) - both):
                        a.append(hub)
                        b.append(nodes[row])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(hub, node)`` that are similar, as ``(a, b)``."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("salts"))
    member = pairs.join(many, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(False).alias("own"))
    centre = many.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    rows = member.unionByName(centre).join(reps, "node").join(texts, "id").select("hub", "node", "own", "text", "salt")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("own")).select("hub", "node", "own", "text")
    return rows.mapInArrow(lambda it: _compare(it, size, percent), "a bigint, b bigint").distinct()


def _shared(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(sig, node, need, hot)``: the rows of signatures that several sets have, once each."""
    salted = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "sig", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    salted = salted.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int"))
    group = "partition by sig, salt"
    several = salted.select("*", F.expr(f"heavy or min(node) over ({group}) <> max(node) over ({group})").alias("shared")).where("shared").drop("shared")
    return several.dropDuplicates(["sig", "salt", "node"]).select("sig", "node", "need", F.expr(f"heavy or count(*) over ({group}) > {HOT}").alias("hot"))


def _without_hot(rows: DataFrame) -> DataFrame:
    """``rows(sig, node, need, hot)`` less what no link needs, as ``(sig, node, band, need, hot, free)``.

    Similar sets share ``need`` rows. A set with fewer than ``need`` hot rows shares
    another row with every similar set, so its hot rows go and its need falls by
    their number: of what a pair shares, no more is hot than either set's hot rows.
    Other sets are ``free``: they keep their hot rows, of which their partners may
    have dropped theirs. Hotness is settled here, once for all rows.
    """
    own = "over (partition by node, need)"
    judged = rows.select("sig", "node", F.col("need").alias("band"), "need", "hot")
    judged = judged.select("*", F.expr(f"count(*) {own}").alias("n"), F.expr(f"count_if(hot) {own}").alias("n_hot")).where("n >= need")
    kept = judged.select("*", (F.col("n_hot") >= F.col("need")).alias("free")).where("free or not hot")
    return kept.withColumn("need", F.when(F.col("free"), F.col("need")).otherwise(F.col("need") - F.col("n_hot")).cast("int")).drop("n", "n_hot")


def _still_open(rows: DataFrame) -> DataFrame:
    """Without sets that have too few rows left for any link.

    Rows leave only together with their group or with sets that have no link, so a
    pair still shares what it did: two free sets ``need`` rows, a free set and
    another at least one row that isn't hot, two others the larger of their needs.
    """
    own = "over (partition by node, band)"
    judged = rows.select("*", F.expr(f"count(*) {own}").alias("n"), F.expr(f"count_if(not hot) {own}").alias("cold"))
    return judged.where("n >= need or free and cold > 0").drop("n", "cold")


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        comps = batch.column(1).to_numpy(zero_copy_only=False)
        for part in slices(batch.column(2)):
            value, bounds = feature_sets(part, size)
            count = np.diff(bounds)
            mine = nodes[part.first : part.first + part.n]
            count_here = np.where(signed(identities(value, bounds)) == mine, count, 0)
            pick = np.repeat(count_here > 0, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(value[pick])), pa.array(np.repeat(mine, count_here)), pa.array(np.repeat(comps[part.first : part.first + part.n], count_here)), pa.array(np.repeat(count_here, count_here).astype(np.int32))],
                ["f", "node", "comp", "s"],
            )


def _remaining_pairs(comp: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose comparison settles the components of the sets that are still open.

    A similar pair shares ``percent`` of the larger set. Pairs that share a feature
    that isn't hot are counted over such features, whose groups hold HOT sets at
    most. All others share hot features only: see ``_hot_pairs``.
    """
    nodes = comp.select("node", "comp").distinct().join(reps, "node").join(texts, "id").select("node", "comp", "text")
    rows = scratch.save(nodes.mapInArrow(lambda it: _features(it, size), "f bigint, node bigint, comp bigint, s int").dropDuplicates(["f", "node"]), "features")
    groups = rows.groupBy("f").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("several")).where("several").drop("several")
    least = f"ceil({percent} * s / 100)"
    rows = rows.join(groups, "f")
    judged = rows.groupBy("node").agg(F.count_if(F.col("df") > HOT).alias("hot"), F.count_if(F.col("df") <= HOT).alias("cold"), F.first("s").alias("s"))
    judged = judged.withColumn("need", F.expr(f"{least} - hot")).where("cold >= need").select("node", "need", "hot")
    rows = scratch.save(rows.join(judged, "node"), "live-features")
    # Of a pair at least so many features are shared, and at most the hot ones of either besides those counted.
    both = f"greatest(ceil({percent} * greatest(s, hub_s) / 100), ceil({percent} * (s + hub_s) / {100 + percent}))"
    counted = _pairs(rows.where(F.col("df") <= HOT)).groupBy("hub", "node").agg(F.count("*").alias("n"), F.first(F.expr(f"{both} - least(hot, hub_hot)")).alias("need"))
    return counted.where("n >= need").select("hub", "node").union(_hot_pairs(rows.where(f"need <= 0 and df > {HOT}"), percent, scratch)).distinct()


def _hot_pairs(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs for sets that share hot features only, from those of ``rows(f, node, comp, s, df)``.

    What such a pair shares is what their hot parts share, so the hot parts are
    similar too, and a smaller set with the same hot part shares as much: whatever
    links with a set links with the smallest of equal hot part in its component. So
    that one stands for them. Of equal hot parts, each component's meets the
    smallest of all; for others, pairs of different components are made by the
    rarest features of their hot parts, where enough others follow.
    """
    part = "struct(count(*) as h, bit_xor(xxhash64(f)) as x, bit_xor(xxhash64(f, 1L)) as y)"
    named = rows.groupBy("node", "comp", "s").agg(F.expr(part).alias("part"))
    standing = named.groupBy("part", "comp").agg(F.min(F.struct("s", "node")).alias("low")).select("part", "comp", "low.s", "low.node")
    standing = scratch.save(standing.withColumn("h", F.col("part.h")), "hot-parts")
    enough = f"{100 + percent} * {{h}} >= {percent} * ({{a}} + {{b}})"
    least = standing.groupBy("part").agg(F.min(F.struct("s", "node")).alias("low"))
    own = standing.join(least, "part").where("node <> low.node").where(enough.format(h="h", a="s", b="low.s")).select(F.col("low.node").alias("hub"), "node")
    # Where the first feature that two parts share is their k-th and hub_k-th, they share no more than follow in
    # either, and it. So a set's rows end where fewer follow than its links need, whatever the other's size is.
    first = rows.select("f", "df", "node").join(standing, "node").withColumn("k", F.expr("row_number() over (partition by node order by df, f)"))
    first = first.withColumn("left", F.expr("h - k + 1")).where(f"left >= ceil({percent} * s / 100)").select("f", "node", "comp", "part", "left", "s")
    other = first.select("f", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("part").alias("hub_part"), F.col("left").alias("hub_left"), F.col("s").alias("hub_s"))
    met = first.join(other, "f").where("comp <> hub_comp and hub < node and part <> hub_part").where(enough.format(h="least(left, hub_left)", a="s", b="hub_s"))
    return own.union(met.select("hub", "node"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs in one group, of different components."""
    other = rows.select("f", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("s").alias("hub_s"), F.col("hot").alias("hub_hot"))
    return rows.join(other, "f").where("comp <> hub_comp and hub < node")


def ngram_jaccard_join(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 75, rounds: int = 1
) -> DataFrame:
    """``(<id>, n_shingles, node, component_id, root, text_hash)`` for each document.

    Words are runs of non-blank bytes with A-Z lower-cased; a document's set holds
    its distinct runs of ``size`` words, or all its words as one run if it has
    fewer. Documents link when ``100 * |A and B| >= percent * |A or B|``.
    ``node`` names the set, so equal sets share it; ``component_id`` is the
    smallest id that links lead to, ``root`` the node that names the component, and
    ``text_hash`` is xxhash64 of the text.

    Null or wordless text: ``n_shingles`` 0, ``node`` and ``root`` null, linked with nothing.
    A null id is never a component_id unless its component holds no other; null-id
    rows link as any other. Rows with one id and several texts are judged each by its
    text.
    Repeated rows give repeated results; an empty table gives an empty result;
    extra columns of ``documents`` are ignored. Sets are compared by 64-bit
    hashes: among n different sets, n*n / 2**65 wrongly equal ones are expected.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    profile = texts.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(lambda it: _profile(it, size), "id bigint, t bigint, n bigint, node bigint")
    profile = scratch.save(profile, "profile")
    rows, few = (df.select("text").mapInArrow(lambda it: _signature_rows(it, size, percent), "sig bigint, node bigint, need int") for df in (texts, texts.where(F.pmod(F.xxhash64("text"), F.lit(HEAVY_SHARE)) == 0)))
    heavy = few.select("sig", "node").distinct().groupBy("sig").count().where(F.col("count") > HOT).orderBy(F.desc("count"), "sig").limit(HEAVY).select("sig")
    open_rows = scratch.save(_without_hot(_shared(rows, scratch.save(heavy, "heavy"))), "open0")
    scratch.drop("heavy")
    # A text that only null ids hold goes by its hash; where that is also an id, the text of the other is passed over.
    reps = profile.where("node is not null").groupBy("node").agg(F.coalesce(F.min("id"), F.min("t")).alias("id"))
    texts = texts.where("id is not null").union(texts.where("id is null").select(F.xxhash64("text").alias("id"), "text").distinct())
    links = spark.range(0).selectExpr("id AS a", "id AS b")
    root = spark.range(0).selectExpr("id AS node", "id AS root")
    for k in range(rounds + 1):
        comp = open_rows.join(root, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        groups = comp.groupBy("sig").agg((F.min("comp") != F.max("comp")).alias("several"), F.count("*").alias("size")).where("several").select("sig", "size")
        comp = scratch.save(_still_open(comp.join(groups, "sig")), f"open{k + 1}")
        scratch.drop(f"open{k}")
        open_rows = comp.drop("comp", "size")
        if comp.isEmpty():
            break
        pairs = _hub_pairs(comp, k) if k < rounds else _remaining_pairs(comp, reps, texts, size, percent, scratch)
        pairs = scratch.save(pairs, f"pairs{k}")
        found = scratch.save(_verified(pairs, reps, texts, size, percent), f"links{k}")
        links = links.union(found)
        root = components(links, Scratch(spark, "jaccard-components"))
    named = profile.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "id").alias("component_id"), "root", F.col("t").alias("text_hash"))


def _hub_pairs(comp: DataFrame, k: int) -> DataFrame:
    """Each set with the hubs, of other components, that it meets most in its groups.

    At first a group's hub is its most central set: the one whose signatures lie in
    the largest groups, as those of an original do among its varied copies. Later
    it is any one of the group, and a set meets several.
    """
    if k == 0:
        central = comp.groupBy("node").agg(F.sum("size").alias("central"))
        keyed = comp.join(central, "node").select("sig", "node", "comp", F.struct((-F.col("central")).alias("o"), "node", "comp").alias("me"))
    else:
        keyed = comp.select("sig", "node", "comp", F.struct(F.xxhash64("node", "sig").alias("o"), "node", "comp").alias("me"))
    first = keyed.groupBy("sig").agg(F.min("me").alias("first"))
    keyed = keyed.join(first, "sig")
    second = keyed.where("comp <> first.comp").groupBy("sig").agg(F.min("me").alias("second"))
    met = keyed.join(second, "sig").select("node", F.when(F.col("comp") == F.col("first.comp"), F.col("second.node")).otherwise(F.col("first.node")).alias("hub"))
    counted = met.groupBy("node", "hub").count().withColumn("k", F.expr("row_number() over (partition by node order by count desc, hub)"))
    return counted.where(F.col("k") <= (1 if k == 0 else HUBS)).select("hub", "node")
