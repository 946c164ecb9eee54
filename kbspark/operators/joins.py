"""Joins of keys, lineage, mappings and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.jobs import settle, sized

FEW = 64  # ranges of a source, new and old ones, all pairs of which are compared


def by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of some keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def capped_adjacency(edges: DataFrame, most: int) -> DataFrame:
    """node, edge_id, src, dst: the first ``most`` edges(edge_id, src, dst) by id at either end of each node; tasks cut before the shuffle."""
    both = edges.withColumn("node", F.col("src")).unionByName(edges.where("src <> dst").withColumn("node", F.col("dst")))
    ranked = both.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("edge_id")))
    return ranked.where(F.col("_n") <= most).select("node", "edge_id", "src", "dst")


def one_hop(seeds: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Node, edge_id, src, dst: up to ``most`` edges(edge_id, src, dst) at either end of each of seeds(node), by id.

    The adjacency is cut first, so a hub has ``most`` rows when the seeds meet it.
    """
    return capped_adjacency(edges, most).join(seeds.select("node").distinct(), "node", "left_semi")


def missing_endpoints(edges: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes at the ends of edges that are not known(node) yet."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(ends.join(known.select("node").distinct(), "node", "left_anti"), "node", "left_semi")


def chunks_of(owners: DataFrame, lineage: DataFrame) -> DataFrame:
    """Chunks of owners(owner_id), as often as both sides say."""
    return owners.join(lineage, "owner_id")


def build_lineage(owners: DataFrame, chunks: DataFrame, kind: str) -> DataFrame:
    """owner_id, chunk_id, source_id, kind of owners(owner_id, chunk_ids) whose chunks(chunk_id, source_id) are known."""
    each = owners.select("owner_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    return each.join(chunks.where("source_id <> ''").select("chunk_id", "source_id"), "chunk_id").select("owner_id", "chunk_id", "source_id", F.lit(kind).alias("kind"))


def with_status(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every key with its row, status success or not_found."""
    return keys.join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_hit"), "success").otherwise("not_found")).drop("_hit")


def by_sources(table: DataFrame, key: str, sources: DataFrame) -> DataFrame:
    """Rows any of whose ``sources`` is among sources(source)."""
    hit = table.select(key, F.explode("sources").alias("source")).join(sources.select("source").distinct(), "source", "left_semi").select(key).distinct()
    return table.join(hit, key, "left_semi")


def rewrite_ends(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with src and dst by mapping(old, canonical); unmapped ones stay, edges with an empty end go."""
    out = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias(end), F.col("canonical").alias("_c"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return out.where("coalesce(cast(src as string), '') <> '' and coalesce(cast(dst as string), '') <> ''").select(*edges.columns)


def task_grid(entities: DataFrame, times: DataFrame, metrics: DataFrame) -> DataFrame:
    """task_id, entity, time, metric: all combinations of three declared lists(position, value), numbered from 1."""
    e, t, m = (df.select(F.col("position").alias(f"{k}_at"), F.col("value").alias(k)) for df, k in ((entities, "entity"), (times, "time"), (metrics, "metric")))
    counts = t.agg(F.count("*").alias("nt")).crossJoin(m.agg(F.count("*").alias("nm")))
    numbered = lambda df, c: df.withColumn(c, F.row_number().over(W.orderBy(c)) - 1)  # noqa: E731  declared lists, a few rows
    grid = e.transform(lambda d: numbered(d, "entity_at")).crossJoin(F.broadcast(numbered(t, "time_at"))).crossJoin(F.broadcast(numbered(m, "metric_at"))).crossJoin(F.broadcast(counts))
    return grid.select((F.col("entity_at") * F.col("nt") * F.col("nm") + F.col("time_at") * F.col("nm") + F.col("metric_at") + 1).cast("long").alias("task_id"), "entity", "time", "metric")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Rows of points(key, at, ...) and ranges(key, low, high, ...) of one key with low <= at < high, whole numbers above -2**63.

    A range is the union of at most two dyadic intervals a power of two (the nodes of a segment tree that cover it),
    and a point lies in one interval of each size, so equality of intervals gives each pair once and no others: the work is
    rows times the sizes in use (64 at most) and matches, whatever the ranges are. Other columns must differ.
    """
    nodes = """filter(flatten(transform(sequence(0, least(63, 1 + cast(log2(cast(high as double) - cast(low as double)) as int))), l -> array(
        named_struct('l', l, 'n', if(pmod(-shiftright(-low, l), 2) = 1 and -shiftright(-low, l) < shiftright(high, l), -shiftright(-low, l), null)),
        named_struct('l', l, 'n', if(pmod(shiftright(high, l), 2) = 1 and -shiftright(-low, l) < shiftright(high, l), shiftright(high, l) - 1, null))))), x -> x.n is not null)"""
    kept = ranges.withColumns({c: F.col(c).cast("long") for c in ("low", "high")}).where("low < high")
    cover = kept.withColumn("_c", F.explode(F.expr(nodes))).select("*", F.col("_c.l").alias("_l"), F.col("_c.n").alias("_n")).drop("_c")
    sizes = sorted(r["_l"] for r in cover.select("_l").distinct().collect())  # at most 64
    if not sizes:
        return points.join(cover.drop("_l", "_n").limit(0), key)
    each = points.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in sizes]))).withColumn("_n", F.expr("shiftright(cast(at as long), _l)"))
    return each.join(cover, [key, "_l", "_n"]).drop("_l", "_n")


def overlapping(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(source_id, new_id, start, end) and old(source_id, old_id, start, end) ranges of a source that overlap.

    Ranges of a source with up to FEW of them are compared with each other. In the others either the old range starts in the new one, or the new one after the start of the old one in it; both are
    joins by ``in_ranges``. Ranges without length or turned round overlap as far as the comparisons of ends say.
    """
    sources = new.select("source_id").unionByName(old.select("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    many = settle(sources.where((F.col("n") > FEW) & F.col("source_id").isNotNull()).select("source_id"), "large-sources")
    o = old.select(F.col("source_id"), "old_id", F.col("start").alias("os"), F.col("end").alias("oe"))
    close = new.select("source_id", "new_id", F.col("start").alias("ns"), F.col("end").alias("ne"))
    if many.isEmpty():
        return close.join(o, "source_id").where("oe > ns and os < ne").select("source_id", "new_id", "old_id")
    many = sized(many)
    few = close.join(many, "source_id", "left_anti").join(o.join(many, "source_id", "left_anti"), "source_id").where("oe > ns and os < ne").select("source_id", "new_id", "old_id")
    new, o = new.join(many, "source_id", "left_semi"), o.join(many, "source_id", "left_semi")
    first = in_ranges(o.withColumn("at", F.col("os")), new.select("source_id", "new_id", F.col("start").alias("low"), F.col("end").alias("high")), "source_id").where("oe > low")
    n = new.select("source_id", "new_id", F.col("start").alias("at"), F.col("end").alias("ne"))
    second = in_ranges(n, o.select("source_id", "old_id", F.try_add(F.col("os").cast("long"), F.lit(1)).alias("low"), F.col("oe").alias("high")), "source_id").where("low - 1 < ne")
    return few.unionByName(first.select("source_id", "new_id", "old_id")).unionByName(second.select("source_id", "new_id", "old_id"))


def triples_in_scope(nodes: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """Scope, src_name, relation, dst_name of edges both of whose nodes(node, name, scope) are in one scope."""
    a = nodes.select(*scope, F.col("node").alias("src"), F.col("name").alias("src_name"))
    b = nodes.select(*scope, F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, ["dst", *scope]).select(*scope, "src_name", "relation", "dst_name")


def incident_by_similarity(similar: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """query_id, src, relation, dst, score: distinct edges at similar(query_id, node, score), best first, ``most`` a query."""
    out = similar.join(edges.withColumn("node", F.col("src")), "node").unionByName(similar.join(edges.withColumn("node", F.col("dst")), "node"))
    one = out.groupBy("query_id", "src", "relation", "dst").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "src", "relation", "dst")))
    return ranked.where(F.col("rank") <= most)


def inconsistent(status: DataFrame, contents: DataFrame) -> DataFrame:
    """Status rows without content: failed ones are preserved, others to be removed."""
    return status.join(contents.select("doc_id"), "doc_id", "left_anti").withColumn("action", F.when(F.col("status") == "failed", "preserve").otherwise("remove"))


def degrees(edges: DataFrame) -> DataFrame:
    """Node, degree: ends of edges(src, dst), by occurrence; distinct edges first if that is meant."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def batch_lookup(keys: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Position, node, found, degree, incident edges' count of keys(position, node), in the order of the keys."""
    d = degrees(edges)
    return keys.join(nodes.select("node").withColumn("found", F.lit(True)), "node", "left").join(d, "node", "left").select("position", "node", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with the sum of the degrees of their ends."""
    d = degrees(edges)
    out = pairs.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src", "left").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst", "left")
    return out.select("src", "dst", (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("degree"))


def with_vectors(elements: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Graph rows with their vector rows where there are any."""
    return elements.join(vectors, key, "left")
