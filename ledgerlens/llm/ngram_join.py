"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed k-word shingles; two documents link when their Jaccard similarity
reaches a threshold. The join is exact (up to 64-bit hash equality):

1. **Partition similar documents into groups.** The hash space is cut into p slots, p depending
   on the size band of a pair. Two sets above the threshold differ in at most H tokens, so with
   p = H + 1 + s slots at least 1 + s slots hold the same tokens in both. Sets too
   small for that use their lowest tokens instead: of n tokens at most
   h = n - ceil(n * num / den) are missing from a linked set, so the h + s lowest of both have s
   in common. s is a fifth of the size, so that a passage of less than half a text makes no candidate. A set that shares fewer slots with others than any link needs is left out at once.
   The smallest set that holds a shared slot leads it; sets with the same smallest leader are a
   group. A slot that many sets of one batch hold is dealt to many tasks.
2. **Token-group matrix.** A block keeps the union of its members' slots (token combinations)
   and, where it is compared, of their tokens, as an inverted list token -> members.
3. **Bound.** A query set meets a block only if the block's union holds one of its rarest slots (all
   but as many of the most frequent ones as a link can do without, so a link always shares one). Then the number of its tokens that lie in the block's union bounds its overlap
   with every member; below the needed overlap the block stays closed.
4. **Open.** In a qualifying block the overlaps with all members come from the inverted list and
   are compared with the threshold in whole numbers. Links are merged at once in a union-find,
   so a block emits a forest, never its pairs.

A family of near-copies does not grow with its square. Three rounds, each exact in what it skips:
first every set of a group is compared with LEADS members of its group only, which joins a family
to one component. Then blocks are made of bounded rows and tokens, a component of PURE sets or more in blocks of its own, and a set
asks only blocks of larger components (sets of small components also each other): two sets of
one component need no comparison. Of a large component only representatives ask at first; the
others ask in the last round, if their component and a larger one are still apart. All links
between components are found; ``every_link`` compares all candidates instead and counts the links.

Equal sets are one node throughout, so copies are never compared or expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, bounded_batches, gram_hashes, mix, stage, text_bytes, text_key, word_hashes, word_table
from ledgerlens.llm.components import connected_components
from ledgerlens.operators.joins import broadcast_if_small

#: Most members and most tokens of a block, most queries of one task's share of a block.
BLOCK_ROWS, BLOCK_TOKENS, BLOCK_QUERIES = 512, 1_000_000, 8192
#: Members of a group that all others are compared with first; sets of a component with blocks of its own.
LEADS, PURE = 16, 512
#: A slot held by this many different sets of one Arrow batch is dealt to many tasks; so many slots
#: at most are (the most frequent ones: this decides balance only).
HOT_SETS, HOT_KEYS = 24, 1 << 14
_SENTINEL = -(1 << 63)
_U = np.uint64
_NEED = 64


def shingle_set(data: bytes | None, k: int, words_of: np.ndarray) -> np.ndarray:
    """Sorted distinct k-word shingles of a text; fewer words: the whole sequence as one."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(data.translate(LOWER), words_of)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def signature(tokens: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    s = np.add.reduce(mix(tokens ^ _U(0xA5A5A5A55A5A5A5A)), dtype=np.uint64) + _U(len(tokens))
    return int(mix(np.array([s], dtype=np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands and slot counts for the threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        first = -(-den // (den - num))  # smallest larger size at which unequal sets can link
        tops, lo = [], first
        while lo < 1 << 40:
            hi = max(lo, lo * den * den // (num * num))
            tops.append(hi)
            lo = hi + 1
        self.first, self.tops = first, np.array(tops)
        lows = [first] + [t + 1 for t in tops[:-1]]
        self.slots, self.slack = [], []
        for lo, hi in zip(lows, tops, strict=True):
            differ = 2 * hi * (den - num) // (den + num)
            n, s = max(1, lo * num // den), 0
            while True:  # empty slots of the band's smallest set are Poisson: their mean and 5 deviations
                p = differ + 1 + s
                mean = p * (1 - 1 / p) ** n if p > 1 else 0.0
                enough = int(np.ceil(mean + 5 * mean**0.5 + 1.5))
                if s >= enough:
                    break
                s = enough
                if p >= n:  # no slack is enough for sets this small: lowest tokens instead of slots
                    p, s = 0, max(1, min(_NEED - 1, hi // 5, n * num // den))
                    break
            self.slots.append(p)
            self.slack.append(s)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n tokens can be the larger or the smaller of a pair."""
        most = n * self.den // self.num
        if most < self.first:
            return []
        b = int(np.searchsorted(self.tops, max(n, self.first)))
        c = int(np.searchsorted(self.tops, most))
        return [b] if b == c else [b, c]

    def keys(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(slot keys, tag) per band; the tag holds the band and the number of keys that any
        link of this set must share (at most _NEED - 1 is asked for). Empty slots have keys only
        in the rare set with more of them than the slack allows for."""
        mixed = None
        for band in self.of(len(tokens)):
            p, s = self.slots[band], self.slack[band]
            if not p:  # a link holds num/den of either set, so s of the lowest tokens kept here
                apart = len(tokens) - -(-self.num * len(tokens) // self.den)
                yield mix(tokens[: apart + s] ^ mix(np.array([band << 44], dtype=np.uint64))), band * _NEED + s
                continue
            slot = ((tokens >> _U(32)) * _U(p)) >> _U(32)
            starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            if mixed is None:
                mixed = mix(tokens + _U(0x1234567))
            used = slot[starts]
            keys = mix(np.add.reduceat(mixed, starts) ^ mix(used + _U(band << 44)))
            empty = p - len(starts)
            if empty > s:
                none = np.setdiff1d(np.arange(p, dtype=np.uint64), used)
                keys = np.concatenate((keys, mix(~(none + _U(band << 44)))))
            yield keys, band * _NEED + min(max(1, 1 + s - empty), _NEED - 1)


def _sets(k: int, num: int, den: int, hot_sets: int):
    """Rows (doc_id, th, n, sig, hot); the first row of a batch has the batch's hot slots."""
    words_of = word_table("blank")

    def run(batches):
        bands = Bands(num, den)
        for b in batches:
            n, sig, held = [], [], {}
            for data in text_bytes(b.column("text")):
                t = shingle_set(data, k, words_of)
                n.append(len(t))
                sig.append(signature(t) if len(t) else None)
                if len(t) and sig[-1] not in held:
                    held[sig[-1]] = [ks for ks, _ in bands.keys(t)]
            every = [ks for own in held.values() for ks in own]
            hot = [None] * len(n)
            if len(held) >= hot_sets and every:
                keys, count = np.unique(np.concatenate(every), return_counts=True)
                hot[0] = keys[count >= hot_sets].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(hot, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n", "sig", "hot"],
            )

    return run


def _salted(at: np.ndarray, sig: int, salts: int) -> np.ndarray:
    """The unit that a set's hot slots (by number) go to: slot number and share of the sets."""
    salt = mix(np.array([sig], dtype=np.int64).view(np.uint64))[0] % _U(salts)
    return (at.astype(np.uint64) << _U(32)) | salt


def _slot_keys(k: int, num: int, den: int, hot: np.ndarray, salts: int):
    """Rows (key, sig, tag); hot slots (sorted, uint64) are cut into ``salts`` units, each with a
    sentinel as its smallest holder."""
    words_of = word_table("blank")

    def run(batches):
        bands, seen, marked = Bands(num, den), set(), set()
        for b in batches:
            keys, sigs, tags = [], [], []
            for data in text_bytes(b.column("text")):
                t = shingle_set(data, k, words_of)
                if not bands.of(len(t)) or (sig := signature(t)) in seen:
                    continue  # copies within a task are one node
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
                for ks, tag in bands.keys(t):
                    if len(hot):
                        place = np.minimum(np.searchsorted(hot, ks), len(hot) - 1)
                        at = hot[place] == ks
                        if at.any():
                            ks = ks.copy()
                            ks[at] = _salted(place[at], sig, salts)
                            new = np.array([x for x in ks[at].tolist() if x not in marked], dtype=np.uint64)
                            marked.update(new.tolist())
                            keys.append(new)
                            sigs.append(np.full(len(new), _SENTINEL, dtype=np.int64))
                            tags.append(np.zeros(len(new), dtype=np.int32))
                    keys.append(ks)
                    sigs.append(np.full(len(ks), sig, dtype=np.int64))
                    tags.append(np.full(len(ks), tag, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(tags))],
                    names=["key", "sig", "tag"],
                )

    return run


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sig) -> (key, sig, tag, lead) of every key held by two or more sets;
    lead is the key's smallest sig. Streams: keeps one row of the key it is in."""
    key = lead = last = pend = None
    for b in batches:
        k, s, t = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        new = np.concatenate(([True], k[1:] != k[:-1]))
        dup = np.concatenate(([False], (k[1:] == k[:-1]) & (s[1:] == s[:-1])))
        cont = key is not None and k[0] == key
        if cont:
            new[0], dup[0] = False, bool(s[0] == last)
        start = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        leads = s[start] if len(start) else np.zeros(0, dtype=np.int64)
        of = np.where(at >= 0, leads[np.maximum(at, 0)] if len(leads) else 0, lead if cont else 0)
        follows = ~new & ~dup
        runs = np.zeros(len(start), dtype=bool)
        runs[at[follows & (at >= 0)]] = True
        emit = follows.copy()
        emit[start[runs]] = True
        out = [k[emit], s[emit], t[emit], of[emit]]
        if cont and pend is not None and (follows & (at < 0)).any():
            out = [np.concatenate(([x], y)) for x, y in zip((key, *pend, pend[0]), out, strict=True)]
            pend = None
        if len(start):
            pend = None if runs[-1] else (s[start[-1]], t[start[-1]])
            lead = leads[-1]
        key, last = k[-1], s[-1]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(d)) for x, d in zip(out, (np.int64, np.int64, np.int32, np.int64), strict=True)],
                names=["key", "sig", "tag", "lead"],
            )


_ROLES = pa.list_(pa.struct([("grp", pa.int64()), ("block", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32())]))


def _placed_sets(k: int):
    """Rows (sig, mult, roles, text) -> the set once for each of its roles."""
    words_of = word_table("blank")

    def run(batches):
        names = ["grp", "block", "salt", "kind"]
        for b in batches:
            for sig, mult, roles, data in zip(b.column("sig").to_pylist(), b.column("mult").to_pylist(), b.column("roles").to_pylist(), text_bytes(b.column("text")), strict=True):
                n = len(roles)
                tokens = shingle_set(data, k, words_of).tobytes()
                where = pa.array(roles, _ROLES.value_type)
                yield pa.RecordBatch.from_arrays(
                    [*(where.field(x) for x in names), pa.array([sig] * n, pa.int64()), pa.array([mult] * n, pa.int64()), pa.array([tokens] * n, pa.binary())],
                    names=[*names, "sig", "mult", "tokens"],
                )

    return run


class _Block:
    """One block: members' tokens, then queries against them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.sigs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.mult: list[int] = []
        self.parent: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.ready = False

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def build(self) -> None:
        self.ready = True
        if not self.sets:
            return
        self.sizes = np.array([len(t) for t in self.sets])
        every = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        self.union = every[self.at]
        self.until = np.append(self.at[1:], len(every))
        self.weight = np.array(self.mult)
        self.least = int(self.sizes.min())

    def probe(self, sig: int, tokens: np.ndarray, mult: int, below: int | None) -> None:
        """Link a query with the members (the first ``below`` of them, if given)."""
        if not self.sets or below == 0:
            return
        n, num, den = len(tokens), self.num, self.den
        i = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        i = i[self.union[i] == tokens]
        if den * len(i) < num * max(n, self.least):  # the overlap bound keeps the block closed
            return
        lo, count = self.at[i], self.until[i] - self.at[i]
        flat = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        both = np.bincount(self.owner[flat], minlength=len(self.sets))
        hit = den * both >= num * (self.sizes + n - both)
        if below is not None:
            hit[below:] = False
        for j in np.flatnonzero(hit):
            other = self.sigs[j]
            if other != sig:
                self.join(sig, other)
                self.links[sig] = self.links.get(sig, 0) + int(self.weight[j])
                self.links[other] = self.links.get(other, 0) + mult

    def forest(self) -> Iterator[tuple[int, int, int]]:
        for x, links in self.links.items():
            yield x, self.root(x), links


def _match(num: int, den: int):
    """Rows sorted by (grp, block, salt, kind, sig): members (kind 0; 1 in the share that also
    compares them with each other comes first as salt 0), then queries (kind 1)."""

    def run(batches):
        block, at, last = None, None, None
        found: list[tuple[int, int, int]] = []

        def flush():
            if block is not None:
                if not block.ready:
                    block.build()
                    if at[2] == 0:
                        within(block)
                found.extend(block.forest())

        def within(blk):
            for j, sig in enumerate(blk.sigs):
                blk.probe(sig, blk.sets[j], blk.mult[j], j)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("grp", "block", "salt", "kind", "sig", "mult")]
            for grp, blk, salt, kind, sig, mult, raw in zip(*cols, b.column("tokens").to_pylist(), strict=True):
                if (grp, blk, salt) != at:
                    flush()
                    block, at, last = _Block(num, den), (grp, blk, salt), None
                if (kind, sig) == last:
                    continue
                last = (kind, sig)
                tokens = np.frombuffer(raw, dtype=np.uint64)
                if kind == 0:
                    block.sigs.append(sig)
                    block.sets.append(tokens)
                    block.mult.append(mult)
                else:
                    if not block.ready:
                        block.build()
                        if salt == 0:
                            within(block)
                    block.probe(sig, tokens, mult, None)
            if found:
                yield _forest_batch(found)
                found = []
        flush()
        if found:
            yield _forest_batch(found)

    return run


def _forest_batch(rows):
    u, v, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "links"])


def _shared_slots(base: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, sig, tag, lead) of every slot that two or more sets hold."""
    spark = base.sparkSession
    often = sets.select(F.explode("hot").alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    found = [r["key"] for r in often.collect()]
    hot = np.sort(np.array(found, dtype=np.int64).view(np.uint64))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = base.select("text").mapInArrow(_slot_keys(k, num, den, hot, salts), "key long, sig long, tag int")
    runs = keys.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(shared_runs, "key long, sig long, tag int, lead long")
    shared = stage(runs, "shared")
    if not found:
        return shared
    cold = shared.where(F.col("lead") != _SENTINEL)
    units = shared.where((F.col("lead") == _SENTINEL) & (F.col("sig") != _SENTINEL)).select("key", "sig", "tag")
    # The leads of the hot slots, HOT_KEYS rows at most, pass the driver.
    ends = units.groupBy(F.shiftrightunsigned("key", 32).alias("slot")).agg(F.min("sig").alias("lead"), F.max("sig").alias("last")).collect()
    leads = {r["slot"]: r["lead"] for r in ends if r["lead"] < r["last"]}
    rows = units.mapInArrow(_with_leads(hot, leads), "key long, sig long, tag int, lead long")
    return stage(cold.unionByName(rows), "shared-all")


def _with_leads(hot: np.ndarray, leads: dict[int, int]):
    """Rows of hot units -> rows of their slots with the slot's lead; slots of one set are dropped."""
    lead = np.array([leads.get(i, 0) for i in range(len(hot))], dtype=np.int64)
    held = np.array([i in leads for i in range(len(hot))], dtype=bool)

    def run(batches):
        for b in batches:
            slot = (b.column("key").to_numpy(zero_copy_only=False).view(np.uint64) >> _U(32)).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array(hot[slot].view(np.int64)), b.column("sig"), b.column("tag"), pa.array(lead[slot])], names=["key", "sig", "tag", "lead"]
            )
            yield out.filter(pa.array(held[slot]))

    return run


def _compared(base: DataFrame, nodes: DataFrame, members: DataFrame, asks: DataFrame, k: int, num: int, den: int, name: str) -> DataFrame:
    """Links (u, v, links) found by opening blocks: ``members`` (sig, grp, block, inner: whether
    the block's members are compared with each other), ``asks`` (sig, grp, block)."""
    blocks = members.groupBy("grp", "block").agg(F.count("*").alias("m"), F.max(F.col("inner").cast("int")).alias("inner"))
    live = blocks.join(asks.groupBy("grp", "block").agg(F.count("*").alias("q")), ["grp", "block"], "left").where("(inner = 1 and m > 1) or q > 0")
    first = F.when(F.col("inner") == 1, 0).otherwise(1)  # the share numbered 0 compares the members
    live = live.select("grp", "block", first.alias("first"), F.ceil(F.coalesce("q", F.lit(1)) / BLOCK_QUERIES).cast("int").alias("salts"))

    def role(salt, kind):
        return F.struct("grp", "block", salt.cast("int").alias("salt"), F.lit(kind).alias("kind"))

    kept = members.select("sig", "grp", "block").join(live, ["grp", "block"]).withColumn("salt", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)))
    asked = F.col("first") + F.pmod(F.xxhash64("sig", F.lit(1)), "salts")
    roles = kept.select("sig", role(F.col("salt"), 0).alias("role")).unionByName(asks.join(live, ["grp", "block"]).select("sig", role(asked, 1).alias("role")))
    plan = roles.groupBy("sig").agg(F.collect_list("role").alias("roles")).join(nodes, "sig")
    plan = stage(plan.select("sig", "mult", "roles", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")), f"{name}-roles")
    same = (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    placed = base.join(broadcast_if_small(plan), same).select("sig", "mult", "roles", "text")
    return stage(
        placed.mapInArrow(_placed_sets(k), "grp long, block int, salt int, kind int, sig long, mult long, tokens binary")
        .repartition("grp", "block", "salt")
        .sortWithinPartitions("grp", "block", "salt", "kind", "sig")
        .mapInArrow(_match(num, den), "u long, v long, links long"),
        f"{name}-links",
    )


def _rarest(asking: DataFrame, matrix: DataFrame) -> DataFrame:
    """The slots that a set looks for blocks by. A link shares ``need`` of them (see the tag), so all
    but the need - 1 that most blocks hold do: one of those it shares is among the others. A
    passage that many sets hold is matched only where it fills a text; slots that no other block
    to be asked holds are left out first."""
    zero = F.when(F.col("to_rank") == 0, F.col("to_grp"))
    reach = matrix.groupBy("key").agg(F.count("*").alias("_held"), F.max("to_rank").alias("_top"), F.min(zero).alias("_low"))
    other = (F.col("_low") < F.col("grp")) | ((F.col("_low") == F.col("grp")) & (F.col("_held") > 1))
    asking = asking.join(reach, "key").where((F.col("_top") > F.col("rank")) | ((F.col("rank") == 0) & other))
    own = Window.partitionBy("sig", "tag")
    asking = asking.withColumns({"_often": F.row_number().over(own.orderBy(F.desc("_held"), "key")), "_slots": F.count("*").over(own)})
    need = F.col("tag") % _NEED
    return asking.where((F.col("_slots") >= need) & (F.col("_often") >= need)).drop("_held", "_top", "_low", "_often", "_slots")


def _asked(asking: DataFrame, matrix: DataFrame, which) -> DataFrame:
    """The matrix of blocks and slots: a set asks a block that holds one of its rarest slots.
    (sig, grp, block)."""
    meets = _rarest(asking, matrix).join(matrix, "key").where(which)
    return meets.select("sig", F.col("to_grp").alias("grp"), F.col("to_block").alias("block")).distinct()


def _forest(base: DataFrame, sets: DataFrame, nodes: DataFrame, k: int, num: int, den: int, every_link: bool) -> DataFrame:
    """Links (u, v, links) between sets that hold their components together; with ``every_link``
    the links of each set are counted."""
    shared = _shared_slots(base, sets, k, num, den)
    able = shared.groupBy("sig", "tag").agg(F.count("*").alias("c")).where(f"c >= tag % {_NEED}").select("sig", "tag")
    shared = stage(shared.join(able, ["sig", "tag"], "left_semi"), "able")
    grouped = stage(shared.groupBy("sig").agg(F.min("lead").alias("grp")).join(nodes, "sig"), "groups")
    facts = grouped.select("sig", "mult", "rep")

    # First round: each set against LEADS members of its group.
    links = None
    comp, size = F.col("sig"), F.lit(1).cast("long")
    own = grouped
    if not every_link:
        leads = grouped.groupBy("grp", F.pmod(F.xxhash64("sig"), F.lit(LEADS)).alias("i")).agg(F.min("sig").alias("sig")).select("sig", "grp")
        leads = stage(leads.withColumns({"block": F.lit(0), "inner": F.lit(True)}), "leads")
        others = grouped.select("sig", "grp", F.lit(0).alias("block")).join(leads.select("sig"), "sig", "left_anti")
        links = _compared(base, facts, leads, others, k, num, den, "leads")
        labels = stage(connected_components(links.select("u", "v")).select(F.col("node").alias("sig"), F.col("label").alias("comp")), "comps")
        sizes = labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= PURE)
        own = grouped.join(labels, "sig", "left").join(sizes, "comp", "left")
        comp, size = F.coalesce("comp", "sig"), F.coalesce("size", F.lit(1).cast("long"))

    # Blocks; rank orders the large components by size, all others have 0.
    wide = "decimal(38,0)"
    rank = F.when(size >= PURE, (size * F.lit(str(1 << 64)).cast(wide) + comp + F.lit(str(1 << 63)).cast(wide)).cast(wide)).otherwise(F.lit(0).cast(wide))
    if every_link:
        rank = F.lit(0).cast(wide)
    own = own.select("sig", "n", comp.alias("comp"), rank.alias("rank"), F.when(rank > 0, F.xxhash64("grp", comp)).otherwise(F.col("grp")).alias("grp"))
    rows = own.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    own = own.join(rows, "grp").withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int"))
    own = stage(own.select("sig", "grp", "block", "comp", "rank"), "blocks")
    members = own.select("sig", "grp", "block", (F.col("rank") == 0).alias("inner"))
    held = shared.select("key", "sig", "tag").join(own, "sig")
    matrix = held.select("key", F.col("grp").alias("to_grp"), F.col("block").alias("to_block"), F.col("comp").alias("to_comp"), F.col("rank").alias("to_rank"))
    matrix = matrix.withColumn("to_comp", F.when(F.col("to_rank") > 0, F.col("to_comp"))).distinct()

    # Second round: sets of small components, and LEADS representatives of the large ones.
    at = F.struct("grp", "block")
    to = F.struct(F.col("to_grp").alias("grp"), F.col("to_block").alias("block"))
    one_side = (F.col("to_rank") > F.col("rank")) | ((F.col("to_rank") == 0) & (F.col("rank") == 0) & (to < at))
    large = own.where("rank > 0")
    chosen = large.groupBy("comp", F.pmod(F.xxhash64("sig"), F.lit(LEADS)).alias("i")).agg(F.min("sig").alias("sig")).select("sig")
    asking = held.where("rank = 0").unionByName(held.where("rank > 0").join(chosen, "sig", "left_semi"))
    asks = _asked(asking, matrix, one_side)
    found = _compared(base, facts, members, stage(asks, "asks"), k, num, den, "blocks")
    links = found if links is None else links.unionByName(found)
    if every_link or large.isEmpty():
        return links

    # Last round: the other sets of large components that are still apart from a larger one.
    labels = connected_components(links.select("u", "v")).select(F.col("node").alias("comp"), "label")
    labels = stage(large.select("comp").distinct().join(labels, "comp"), "large")
    slots = held.where("rank > 0").join(labels, "comp")
    apart = slots.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    asking = slots.join(apart, "key", "left_semi").join(chosen, "sig", "left_anti")
    targets = matrix.where("to_rank > 0").join(labels.select(F.col("comp").alias("to_comp"), F.col("label").alias("to_label")), "to_comp")
    rest = stage(_asked(asking, targets, (F.col("to_rank") > F.col("rank")) & (F.col("to_label") != F.col("label"))), "rest")
    if rest.isEmpty():
        return links
    return links.unionByName(_compared(base, facts, members.where("not inner"), rest, k, num, den, "rest"))


def _linked(docs: DataFrame, k: int, num: int, den: int, every_link: bool = False) -> DataFrame:
    """(doc_id, th, comp, n_shingles, component_id, component_rows, n_links) of every row; comp
    names the component (null for a row without words)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", text_key())

    sets = stage(base.mapInArrow(_sets(k, num, den, HOT_SETS), "doc_id long, th long, n long, sig long, hot array<long>"), "sets")
    nodes = (
        sets.where("sig is not null")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("mult"), F.min("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("rep"))
    )
    forest = _forest(base, sets, nodes, k, num, den, every_link)
    labels = connected_components(forest.select("u", "v")).withColumnRenamed("node", "sig")
    links = forest.groupBy(F.col("u").alias("sig")).agg(F.sum("links").alias("links"))
    by_sig = nodes.select("sig", "first_id", "mult").join(labels, "sig", "left").join(links, "sig", "left").withColumn("comp", F.coalesce("label", "sig"))
    low = by_sig.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.sum("mult").alias("component_rows"))
    by_sig = by_sig.join(low, "comp").select("sig", "comp", "component_id", "component_rows", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return sets.join(by_sig, "sig", "left").select(
        "doc_id",
        "th",
        "comp",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_rows", F.lit(1)).cast("long").alias("component_rows"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, every_link: bool = False) -> DataFrame:
    """Components of the graph that links documents with Jaccard similarity >= num/den over
    distinct k-word shingles (words: runs of characters other than ASCII white space, A-Z
    lower-cased). Needs columns doc_id (integer) and text; others are ignored.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable
    by links, itself included), component_rows (rows of the component); with ``every_link`` also
    n_links, the number of other rows linked directly (all candidate pairs are compared then, so
    the work grows with the number of links).

    Defined cases: a null or blank text has n_shingles 0, is linked with nothing and has its own
    doc_id as component_id; fewer than k words make one shingle of the whole sequence; repeated
    rows (even with the same doc_id) are kept and linked with each other; a null doc_id counts
    as no candidate for the smallest id; an empty table gives an empty result.
    """
    counted = ["n_links"] if every_link else []
    return _linked(docs, k, num, den, every_link).select("doc_id", "n_shingles", "component_id", "component_rows", *counted)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (all columns unchanged) with one of each group of linked documents
    left: the smallest doc_id (null last), of one doc_id the smallest text hash, of equal rows
    one. Rows without words are in no group and stay. Same cases as :func:`jaccard_components`."""
    rows = stage(_linked(docs, k, num, den).where("comp is not null").select("doc_id", "th", "comp"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = rows.groupBy("comp").agg(F.min(order).alias("first"))
    gone = rows.join(first, "comp").where(order != F.col("first")).select(F.col("doc_id").alias("__keep_id"), F.col("th").alias("__keep_th")).distinct()
    twice = stage(rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__keep_id"), F.col("th").alias("__keep_th")), "twice")

    def same(df):
        return df["doc_id"].cast("long").eqNullSafe(F.col("__keep_id")) & (text_key() == F.col("__keep_th"))

    left = docs.join(broadcast_if_small(gone), same(docs), "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, same(left), "left_semi").withColumn("__keep_key", text_key()).dropDuplicates(["doc_id", "__keep_key"]).drop("__keep_key")
        left = left.join(twice, same(left), "left_anti").unionByName(again)
    return left
