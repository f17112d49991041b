"""Components of an exact Jaccard join of word shingles, by adaptive multi-match prefixes.

Shingles are ordered by their hash.  Of two linked sets of n and n' shingles the first n - t + k
and n' - t' + k share at least k, where t is the least overlap that a partner needs.  A shingle
that too many sets would have to be compared for is skipped.  A document that posts p shingles, s of
them skipped, shares at least p - s - n + t others with a partner that posts no fewer: its matches.
A document with less than two matches gets a longer prefix, until the new shingles leave it two; all
others ask for as many shared shingles as the smaller of two documents has matches.  A document of
which nearly all shingles are skipped never has two; these documents, whole, are compared with
each other where they share a skipped shingle.

Equal sets are one node.  Before prefixes are compared each node is verified against one central
node of those it shares small hashes with; a shingle all of whose nodes are linked by then needs no
comparison, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gsx.llm.components import components
from gsx.llm.texts import word_lists
from gsx.operators.ordered import lookup_join
from gsx.session import settle, ship

SHINGLE = 5
PERCENT = 80
#: Matches of the shortest useful prefix.
MATCHES = 2
#: Nodes that a shingle may have before it is skipped.
CROWD = 32
#: Smallest hashes of a node by which it is offered a central node, and how many must agree.
STARS, STARS_MIN = 6, 3
#: Texts that one task compares with one centre, or all with each other.
CHUNK = 512
#: Keys of 8 bytes that are sent to every executor instead of moving the rows they select.
SENT_KEYS = 1 << 21


def hashed_shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` lower-case (A-Z) words, ascending.

    With fewer words all of them are one run; without words there is none.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    found, tail = [], []
    for words in word_lists(data.lower()):
        words = tail + words
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
        if len(words) < size:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[size - 1 :])]
        found.append(np.array(hashes, np.uint64))
    if not found:
        found = [np.array([digest(b" ".join(tail))] if tail else [], np.uint64)]
    return np.unique(np.concatenate(found))


def least_overlap(n, percent: int):
    """Smallest overlap that a set of ``n`` may have with a linked one."""
    return -(-n * percent // 100)


def _least(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _small(keys: DataFrame) -> DataFrame:
    """Settled ``keys``, marked for a broadcast when their count allows it."""
    keys = settle(keys)
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def _described(size: int, percent: int):
    """Number of shingles, digest of the set and posted prefix of every text."""
    import hashlib

    from pyspark import TaskContext

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for raw in batch.column(0):
                own = hashed_shingles(raw.as_py(), size)
                n = len(own)
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                prefixes.append(own[: n - least_overlap(n, percent) + MATCHES + n // 32 + 2].view(np.int64))
            rid = np.arange(at, at + len(sizes))
            at += len(sizes)
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(rid, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                names=[*batch.schema.names[1:], "rid", "n", "digest", "prefix"],
            )

    return described


def _longer(size: int):
    """The shingles of a text from place ``posted`` to place ``upto`` of its order."""

    def longer(batches):
        for batch in batches:
            rid, posted, upto = (batch.column(i).to_numpy() for i in (1, 2, 3))
            parts = [
                hashed_shingles(raw.as_py(), size)[a:b].view(np.int64)
                for raw, a, b in zip(batch.column(0), posted.tolist(), upto.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(rid, [len(p) for p in parts])),
                    pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)),
                ],
                names=["rid", "token"],
            )

    return longer


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(size: int, percent: int):
    """Links of a group's nodes with its centre, which comes first."""

    def stars(batches):
        rows = (
            row
            for batch in batches
            for row in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3))
        )
        for key, group in groupby(rows, lambda r: r[:2]):
            centre, found = None, []
            for _, _, rid, raw in group:
                own = hashed_shingles(raw.as_py(), size)
                if rid == key[0]:
                    centre = own
                elif _linked(centre, own, percent):
                    found.append(rid)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"]
            )

    return stars


def joined_roots(sets: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of indexes that link what ``root`` does not link yet; ``root`` is changed."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, links = np.zeros(ids.max(initial=0) + 1, bool), []
    for i in range(len(sets) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[starts[i + 1] :]].astype(np.int64), starts[i + 1 : -1] - starts[i + 1])
        mark[own] = False
        near = i + 1 + np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both))
        for j in near.tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _crowds(size: int, percent: int):
    """Links between the nodes of a group, all of them compared."""

    def crowds(batches):
        rows = (
            row
            for batch in batches
            for row in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5))
        )
        for _, group in groupby(rows, lambda r: r[:3]):
            names, roots, sets = [], [], []
            for *_, rid, root, raw in group:
                names.append(rid)
                roots.append(root)
                sets.append(hashed_shingles(raw.as_py(), size))
            found = joined_roots(sets, np.array(roots), percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return crowds


class Join:
    """The state of one join: nodes, posted shingles and links found so far."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int, percent: int):
        self.size, self.percent = size, percent
        raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
        self.texts = docs.select(raw.alias("raw"), F.unhex(F.sha2(raw, 256)).alias("sha"))
        rows = docs.select(raw.alias("raw"), F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        self.rows = settle(
            rows.mapInArrow(
                _described(size, percent),
                f"doc_id {kind}, sha binary, rid bigint, n bigint, digest binary, prefix array<bigint>",
            )
        )
        full = self.rows.filter("digest IS NOT NULL")
        self.classes = settle(full.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("low")))
        self.nodes = full.select("rid", "sha", "n", "prefix").join(
            _small(self.classes.select("rid")), "rid", "left_semi"
        )

    # --- texts ---------------------------------------------------------------------------

    def with_text(self, nodes: DataFrame) -> DataFrame:
        """(rid, more..., raw) of ``nodes``, which has a row per node; equal texts are read once."""
        named = settle(nodes.join(self.nodes.select("rid", "sha"), "rid"))
        raw = lookup_join(self.texts, named.select("sha", "rid"), "sha")
        return raw.groupBy("rid").agg(F.first("raw").alias("raw")).join(named.drop("sha"), "rid")

    # --- links -----------------------------------------------------------------------------

    def star_links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of ``pairs`` (centre a, node b) that are linked."""
        pairs = settle(pairs.select("a", "b").distinct())
        held = self.with_text(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
        cuts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("cuts"))
        dealt = lookup_join(pairs, cuts, "a").select(
            "a", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("cut"), F.col("b").alias("rid")
        )
        centres = cuts.select("a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("a").alias("rid"))
        sent = dealt.unionByName(centres).join(held, "rid").select("a", "cut", "rid", "raw")
        sorted_ = sent.repartition("a", "cut").sortWithinPartitions("a", "cut", F.col("rid") != F.col("a"))
        return settle(sorted_.mapInArrow(_stars(self.size, self.percent), "a bigint, b bigint"))

    def central_pairs(self) -> DataFrame:
        """(a, b): every node b with the most central node of those it shares smallest hashes with."""
        star = self.nodes.select("rid", F.explode(F.slice("prefix", 1, STARS)).alias("token"))
        sizes = star.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        shared = settle(lookup_join(star, sizes, "token"))
        weight = shared.groupBy("rid").agg(F.sum("m").alias("w"))
        best = (
            shared.join(weight, "rid").groupBy("token").agg(F.max(F.struct("w", F.negative("rid").alias("r"))).alias("c"))
        )
        met = lookup_join(shared.select("rid", "token"), best, "token").select("rid", F.negative("c.r").alias("a"))
        votes = met.filter("a <> rid").groupBy("rid", "a").agg(F.count(F.lit(1)).alias("c"))
        return (
            votes.filter(F.col("c") >= STARS_MIN)
            .groupBy("rid")
            .agg(F.max_by("a", F.struct("c", "a")).alias("a"))
            .select("a", F.col("rid").alias("b"))
        )

    # --- postings ----------------------------------------------------------------------------

    def first_shared(self) -> DataFrame:
        """(token, rid, m): posted shingles that ``m`` > 1 nodes post."""
        posted = self.nodes.select("rid", F.explode("prefix").alias("token"))
        sizes = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        return settle(posted.join(sizes, "token"))

    def lengthened(self, shared: DataFrame, more: DataFrame, added: DataFrame) -> DataFrame:
        """``shared`` after the shingles ``added`` are posted, of all added ones ``more``."""
        every = self.nodes.select("rid", F.explode("prefix").alias("token")).unionByName(more)
        touched = _small(added.select("token").distinct())
        rows = settle(every.join(touched, "token", "left_semi"))
        sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        rest = shared.join(touched, "token", "left_anti")
        return settle(rest.unionByName(rows.join(sizes, "token").select(rest.columns)))

    def links(self) -> DataFrame:
        """(a, b): links between nodes that span all components."""
        found = self.star_links(self.central_pairs())
        roots = settle(components(found, "a", "b").select(F.col("node").alias("rid"), "root"))
        shared, more = self.first_shared(), None
        lengths = self.nodes.select("rid", "n", F.size("prefix").cast("bigint").alias("posted"))
        while True:
            rooted = lookup_join(shared, roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
            # shingles whose nodes are not all linked
            open_ = settle(
                rooted.groupBy("token")
                .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("m").alias("m"))
                .filter("lo < hi")
                .select("token", "m")
            )
            crowded = lookup_join(rooted.select("rid", "root", "token"), open_.filter(F.col("m") > CROWD), "token")
            crowded = settle(crowded)
            skipped = crowded.groupBy("rid").agg(F.count(F.lit(1)).alias("skipped"))
            matches = F.col("posted") - F.coalesce("skipped", F.lit(0)) - F.col("n") + _least(F.col("n"), self.percent)
            matched = settle(
                lengths.join(skipped, "rid", "left").select("rid", "n", "posted", "skipped", matches.alias("matches"))
            )
            short = matched.filter(f"skipped > 0 AND matches < {MATCHES}").withColumn("lack", MATCHES - F.col("matches"))
            wanting = short.filter("posted < n").select(
                "rid", "posted", F.least(F.col("n"), F.col("posted") + 2 * F.col("lack") + F.floor(F.col("n") / 8)).alias("upto")
            )
            if wanting.isEmpty():
                break
            added = self.with_text(wanting).select("raw", "rid", "posted", "upto")
            added = settle(added.mapInArrow(_longer(self.size), "rid bigint, token bigint"))
            more = added if more is None else more.unionByName(added)
            shared = self.lengthened(shared, more, added)
            longer = added.groupBy("rid").agg(F.count(F.lit(1)).alias("more"))
            lengths = settle(
                lengths.join(longer, "rid", "left").select(
                    "rid", "n", (F.col("posted") + F.coalesce("more", F.lit(0))).alias("posted")
                )
            )
        pairs = self.crowd_free_pairs(rooted, open_.filter(F.col("m") <= CROWD), matched)
        more_links = self.star_links(pairs)
        whole = self.whole_links(crowded, short)
        return found.unionByName(more_links).unionByName(whole)

    def crowd_free_pairs(self, rooted: DataFrame, few: DataFrame, matched: DataFrame) -> DataFrame:
        """(a, b): nodes of different roots that share enough posted shingles of at most CROWD nodes.

        A link of two documents shares the matches of one of them; one without matches leaves
        the number to the other, and two of them share a shingle.
        """
        rows = rooted.select("rid", "root", "token").join(_small(few.select("token")), "token", "left_semi")
        # a set too small for MATCHES shares all it has; one without matches asks for none of its own
        asked = F.when(F.col("matches") > 0, F.col("matches")).otherwise(F.col("n") + 1)
        sized = rows.join(matched.select("rid", "n", asked.alias("k"), (F.col("matches") <= 0).alias("w")), "rid")
        bag = sized.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("rid", "root", "n", "k", "w"))).alias("g"))
        both = F.explode(
            F.expr(
                f"flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, {CROWD}), y -> y.root <> x.root "
                f"AND 100 * least(x.n, y.n) >= {self.percent} * greatest(x.n, y.n)), "
                "y -> struct(x.rid AS a, y.rid AS b, IF(x.w AND y.w, 1, least(x.k, y.k)) AS k))))"
            )
        )
        counted = bag.select(both.alias("p")).select("p.*").groupBy("a", "b", "k").agg(F.count(F.lit(1)).alias("c"))
        return counted.filter("c >= k").select("a", "b")

    def whole_links(self, crowded: DataFrame, short: DataFrame) -> DataFrame:
        """Links between documents that post all their shingles, most of them skipped ones.

        Each brings as many of its skipped shingles, the rarest first, as its prefix lacks.
        """
        rows = crowded.join(short.select("rid", "lack"), "rid")
        place = F.row_number().over(Window.partitionBy("rid").orderBy("m", "token"))
        rows = settle(rows.withColumn("place", place).filter("place <= lack").select("token", "rid", "root"))
        cuts = rows.groupBy("token").agg(
            F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("cuts"),
            F.min("root").alias("lo"), F.max("root").alias("hi"),
        ).filter("lo < hi").select("token", "cuts")
        own = F.pmod(F.xxhash64("rid"), F.col("cuts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: c != F.col("own"))
        # cut c meets every other cut; a single one meets itself
        meets = F.when(F.col("cuts") > 1, others).otherwise(F.array(F.lit(0)))
        dealt = (
            lookup_join(rows, cuts, "token")
            .withColumn("own", own)
            .withColumn("other", F.explode(meets))
            .select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rid", "root")
        )
        held = self.with_text(rows.select("rid").distinct())
        sent = dealt.join(held, "rid").select("token", "p", "q", "rid", "root", "raw")
        sorted_ = sent.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "rid")
        return settle(sorted_.mapInArrow(_crowds(self.size, self.percent), "a bigint, b bigint"))


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    Two documents link when 100 times the common ones of their distinct runs of ``shingle`` lower-case
    (A-Z) words are at least ``percent`` times all of them; fewer words are one run.  NULL and
    empty texts have no runs and link with nothing, so their component is their own id.
    ``component_id`` is the smallest doc_id reachable; a NULL id is skipped by the minimum.  Rows
    may repeat; other columns are ignored; an empty table gives no rows.  Shingles are compared
    by 64-bit hashes, whole sets by 128-bit digests.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent from 50 to 100")
    ship(docs.sparkSession)
    join = Join(docs, doc_id, text, shingle, percent)
    roots = components(join.links(), "a", "b").select(F.col("node").alias("rid"), "root")
    rooted = settle(
        join.classes.join(roots, "rid", "left").select("digest", "low", F.coalesce("root", "rid").alias("root"))
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("digest", "component_id", F.lit(True).alias("full"))
    out = lookup_join(join.rows.select("doc_id", "n", "digest"), named, "digest", "left")
    component = F.when(F.col("full"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
