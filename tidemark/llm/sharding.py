"""Balanced label propagation: linked documents move to their neighbours' shards, row counts stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import running, text_key, with_row
from tidemark.session import cut

N_SHARDS = 24
LARGE = 32  # a hub is large above this part of a shard
FREE = -1  # target of documents without links: any shard


def flows(wish: dict[tuple[int, int], int], free: dict[int, int], n: int) -> tuple[dict, dict]:
    """How many documents may move: linked ones by (from, to), and free ones by (from, to) to even it out.

    A shard that would gain more linked documents than it loses must send away free ones; where it has too
    few, fewer may come in. Lowering one flow can only lower what its source shard may take, so this ends.
    """
    allowed = dict(wish)
    while True:
        gain = [sum(v for (_, t), v in allowed.items() if t == k) - sum(v for (s, _), v in allowed.items() if s == k) for k in range(n)]
        over = {k: g - free.get(k, 0) for k, g in enumerate(gain) if g > free.get(k, 0)}
        if not over:
            break
        for k, excess in over.items():
            for cell in sorted((c for c in allowed if c[1] == k), key=lambda c: (allowed[c], c)):
                less = min(excess, allowed[cell])
                allowed[cell] -= less
                excess -= less
    out: dict[tuple[int, int], int] = {}
    give = [[k, g] for k, g in enumerate(gain) if g > 0]
    for k, need in ((k, -g) for k, g in enumerate(gain) if g < 0):
        while need:
            sent = min(need, give[-1][1])
            out[give[-1][0], k] = out.get((give[-1][0], k), 0) + sent
            need -= sent
            give[-1][1] -= sent
            if not give[-1][1]:
                give.pop()
    return allowed, out


def pack(hubs: list[tuple[int, dict[int, int]]], left: list[int]) -> list[list[tuple[int, int]]]:
    """Shards of hubs (size, members by shard), the largest first: pieces (shard, size) of each hub. Takes the room from `left`.

    A hub goes whole to the shard that holds most of it among those with room for it. If none has, it is cut
    into as few pieces as the largest rooms allow, a tenth smaller than these since pieces are drawn by hash.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in hubs]
    for h in sorted(range(len(hubs)), key=lambda h: (-hubs[h][0], h)):
        size, held = hubs[h]
        while size:
            fits = [t for t, room in enumerate(left) if room >= size]
            if fits:
                to, part = max(fits, key=lambda t: (held.get(t, 0), -left[t], -t)), size
            else:
                to = max(range(len(left)), key=lambda t: (left[t], held.get(t, 0), -t))
                part = min(size, max(1, int(left[to] / 1.1))) if left[to] > 0 else size
            out[h].append((to, part))
            left[to] -= part
            size -= part
    return out


def targets(counts: DataFrame, rows: int, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """Where hubs go, from counts (hub, shard, n): (hub, n, held, lo, hi, target) of large or cut hubs, (hub, n, held, target) of the others.

    Large hubs, at most LARGE x n_shards if a document has one hub, are packed first. The others go round by
    round to the shard that holds most of them among those with room; where more wish than fit, the largest
    go first and the rest try the next best shard. What fits nowhere is packed in pieces; that is less than
    n_shards hubs if a document has one hub, and the largest LARGE x n_shards are packed anyway.
    """
    spark = counts.sparkSession
    left = [rows // n_shards + (k < rows % n_shards) for k in range(n_shards)]
    held = F.map_from_entries(F.collect_list(F.struct("shard", "n")))  # n_shards entries at most
    hubs = cut(counts.groupBy("hub").agg(F.sum("n").alias("n"), held.alias("held")))
    cap, order = LARGE * n_shards, [F.desc("n"), F.xxhash64("hub"), "hub"]
    pieces: list[tuple] = []

    def packed(chosen: DataFrame) -> None:
        got = chosen.orderBy(*order).limit(cap).collect()
        for r, parts in zip(got, pack([(r["n"], r["held"]) for r in got], left), strict=True):
            lo = 0
            for shard, n in parts:
                pieces.append((r["hub"], r["n"], r["held"], lo, lo + n, shard))
                lo += n

    big = max(1, rows // n_shards // LARGE)
    packed(hubs.filter(F.col("n") > big))
    pending = hubs.filter(F.col("n") <= big)
    placed = None
    while True:
        room = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(v).cast("long").alias("left")) for k, v in enumerate(left)])
        fits = F.filter(room, lambda s: s["left"] >= F.col("n"))
        best = F.array_max(F.transform(fits, lambda s: F.struct(
            F.coalesce(F.try_element_at("held", s["shard"]), F.lit(0)).alias("n"), F.xxhash64("hub", s["shard"]).alias("tie"), s["shard"].alias("shard"))))
        wishes = pending.withColumn("target", best["shard"]).filter(F.col("target").isNotNull())
        ranked = running(wishes.withColumn("less", -F.col("n")).withColumn("tie", F.xxhash64("hub")), ["less", "tie", "hub"], group=["target"], value="n")
        limit = F.element_at(F.array(*[F.lit(v).cast("long") for v in left]), F.col("target") + 1)
        accepted = cut(ranked.filter(F.col("_before") + F.col("n") <= limit).select("hub", "n", "held", "target"))
        took = accepted.groupBy("target").agg(F.sum("n").alias("n")).collect()
        if not took:
            break
        for r in took:
            left[r["target"]] -= r["n"]
        placed = accepted if placed is None else placed.unionByName(accepted)
        pending = cut(pending.join(accepted.select("hub"), "hub", "left_anti"))
    packed(pending)
    whole = accepted if placed is None else placed
    schema = hubs.select("hub", "n", "held", F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(0).alias("target")).schema
    return spark.createDataFrame(pieces, schema), whole


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shards (_row, shard) for nodes (_row, order) so that counts differ by one at most and few links are cut.

    `links` (_row, hub): documents with a hub in common are neighbours; a document may have several hubs.
    Pairs are never formed: a round counts documents per (hub, shard), finds each hub a shard with room for
    it (`targets`), and each document wishes to go to the target of the hub that gains it most neighbours.
    A hub that fits nowhere whole is split by hash.
    Quotas per (from, to) pair come from the counts of wishes (n_shards squared rows at most); every
    document that moves is matched by one that moves away, a wisher or one without links, so counts never
    change. Where a quota is short, documents with the largest gain go first, hub by hub. Rounds go on until
    no document moves or the number of documents in their hub's main shard no longer grows.
    `order` breaks ties; repeated links count once; null hubs are no links; empty nodes give no rows.
    """
    spark = nodes.sparkSession
    state = running(nodes, ["order", "_row"])
    state = cut(state.select("_row", "order", (F.col("_no") % n_shards).cast("int").alias("shard")))
    rows = state.count()
    links = links.filter(F.col("hub").isNotNull()).distinct()
    sized = links.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub")
    links = cut(links.join(sized, "hub").select("_row", "hub"))
    alone = cut(state.select("_row").join(links.select("_row").distinct(), "_row", "left_anti"))
    together = -1
    while True:
        placed = cut(links.join(state, "_row"))
        counts = cut(placed.groupBy("hub", "shard").agg(F.count("*").alias("n")))
        now = counts.groupBy("hub").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
        if now <= together or not now:
            break
        together = now
        pieces, whole = targets(counts, rows, n_shards)
        at = F.pmod(F.xxhash64("_row"), F.col("n"))
        # at most LARGE n_shards hubs and n_shards pieces each, few of them cut
        cols = [*placed.columns, "held", "target"]
        large = placed.join(F.broadcast(pieces), "hub").filter((at >= F.col("lo")) & (at < F.col("hi"))).select(*cols)
        aims = large.unionByName(placed.join(whole, "hub").select(*cols))
        aims = aims.withColumn("gain", F.coalesce(F.try_element_at("held", F.col("target")), F.lit(0)) - F.col("held")[F.col("shard")])
        wishes = aims.groupBy("_row").agg(
            F.max(F.struct("gain", F.xxhash64("hub", "target").alias("tie"), "target", "hub")).alias("w"),
            F.first("shard").alias("shard"), F.first("order").alias("order"),
        )
        wishes = wishes.filter(F.col("w.target") != F.col("shard")).select(
            "_row", "order", "shard", F.col("w.target").alias("target"), (-F.col("w.gain")).alias("rank"), F.xxhash64("w.hub").alias("hub"),
        )
        free = alone.join(state, "_row").select(
            "_row", "order", "shard", F.lit(FREE).alias("target"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("hub"),
        )
        moves = running(wishes.unionByName(free), ["rank", "hub", "order", "_row"], group=["shard", "target"])
        moves = cut(moves)
        cells = {(r["shard"], r["target"]): r["n"] for r in moves.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        allowed, sent = flows({c: n for c, n in cells.items() if c[1] != FREE}, {c[0]: n for c, n in cells.items() if c[1] == FREE}, n_shards)
        if not sum(allowed.values()):
            break
        rules = [(s, t, 0, n, t) for (s, t), n in sorted(allowed.items())]
        at: dict[int, int] = {}
        for (s, t), n in sorted(sent.items()):
            rules.append((s, FREE, at.get(s, 0), at.get(s, 0) + n, t))
            at[s] = at.get(s, 0) + n
        quota = F.broadcast(spark.createDataFrame(rules, "shard int, target int, lo long, hi long, new int"))  # 2 n_shards^2 rows at most
        go = moves.join(quota, ["shard", "target"]).filter("_no >= lo and _no < hi").select("_row", "new")
        state = cut(state.join(go, "_row", "left").select("_row", "order", F.coalesce("new", "shard").alias("shard")))
    return state


def shard_rows(rows: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Adds shard and slot to (_row, doc_id, size, crc, key): documents of equal key are linked."""
    spread = rows.select("_row", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "crc", "size").alias("order"))
    placed = propagate(spread, rows.select("_row", F.col("key").alias("hub")), n_shards)
    slots = running(placed, ["order", "_row"], number="slot", group=["shard"]).select("_row", "shard", "slot")
    return rows.join(slots, "_row")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    return docs.select(
        F.struct("*").alias("doc"), "doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), text_key(text).alias("key")
    )


def shard_table(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document of (doc_id, text).

    The law is `rows`. Null texts have no bytes and are linked to nothing; empty texts are equal texts.
    Repeated rows and ids are rows of their own. Empty input gives no rows.
    """
    rows = with_row(_measured(docs).select("doc_id", "size", "crc", "key"))
    return shard_rows(rows, n_shards).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """`docs` with their shard and slot, whatever other columns they have (a `shard` or `slot` among them is replaced)."""
    staged = with_row(_measured(docs))
    placed = shard_rows(staged.select("_row", "doc_id", "size", "crc", "key"), n_shards).select("_row", "shard", "slot")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return staged.join(placed, "_row").select(*kept, "shard", "slot")
