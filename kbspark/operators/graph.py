"""Graph jobs: classes, canonical names, subgraphs, edits, merges, retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.jobs import components, partitions, release, settle, sized, spread
from kbspark.operators import aggregates, joins, ranking, vectors


def equivalence(mappings: DataFrame) -> DataFrame:
    """G1: name, root of mappings(old, canonical) closed transitively; root is the smallest name of a class."""
    return components(mappings.where("old <> canonical").select(F.col("old").alias("a"), F.col("canonical").alias("b"))).select(F.col("node").alias("name"), F.col("component").alias("root"))


def canonical_names(classes: DataFrame) -> DataFrame:
    """Root, canonical of classes(root, name): names with CJK first, then the longest, then by order of the name."""
    pick = F.struct((~F.col("name").rlike("[\\u4e00-\\u9fff]")).alias("c"), (-F.length("name")).alias("l"), F.col("name").alias("n"))
    return classes.groupBy("root").agg(F.min(pick)["n"].alias("canonical"))


def mapping_table(mappings: DataFrame) -> DataFrame:
    """Old, canonical for every name of chained mappings."""
    classes = equivalence(mappings)
    return classes.join(canonical_names(classes), "root").select(F.col("name").alias("old"), "canonical")


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """G3 with ``*``: the n nodes of highest degree."""
    return joins.degrees(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()).orderBy(F.desc("degree"), "node").limit(n)


STARTS = 512  # of a block, about, whose searches share the lists of neighbours that a task holds


def _picked(values: np.ndarray, begins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists ``at``, the number of values of each)."""
    size = begins[at + 1] - begins[at]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return values[np.repeat(begins[at], size) + place], size


def _coded_lists(t: pa.Table):
    """(codes, values of their lists, where each begins, names) of lists of codes."""
    t = t.combine_chunks().sort_by("code").combine_chunks()
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(t["list"]).to_numpy())]).astype(np.int64)
    return t["code"].to_numpy(), pc.list_flatten(t["list"]).to_numpy(), begins, t["name"]


def _by_block(each: Callable, names: list[str], held: Callable = _coded_lists):
    """Rows sorted by block, its lists (kind 0) before its starts (kind 1): each(lists as ``held`` gives them, batch of starts) gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, lists = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(i, j - i)
                if part.column("block")[0].as_py() != block:
                    block, parts, lists = part.column("block")[0].as_py(), [], None
                if part.column("kind")[0].as_py() == 0:
                    parts.append(part)
                    continue
                if lists is None:
                    lists, parts = held(pa.Table.from_batches(parts, batch.schema)), []
                for out in each(lists, part):
                    yield pa.RecordBatch.from_arrays(out, names)

    return run


def _grown(most: int):
    """Starts with the next level: the unseen neighbours of the last one, in the order of codes, up to most + 1 nodes in all."""

    def each(lists, part: pa.RecordBatch):
        codes, values, begins, _ = lists
        seen, ends = [], []
        for s, e in zip(part.column("list"), part.column("ends"), strict=True):
            s, e = s.values.to_numpy(), e.as_py()
            near, _ = _picked(values, begins, np.searchsorted(codes, s[e[-2] if len(e) > 1 else 0 :]))
            new = np.setdiff1d(near, s)[: most + 1 - len(s)]
            seen.append(np.concatenate([s, new]))
            ends.append([*e, len(s) + len(new)])
        yield [part.column("block"), part.column("code"), part.column("name"), pa.array(seen, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32()))]

    return each


def _between(lists, starts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each start: (places of its nodes, ends of the edges between them)."""
    codes, values, begins, _ = lists
    inside = np.zeros(len(codes), bool)
    local = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
    local[codes[local] != values] = -1
    for s in starts:
        at = np.searchsorted(codes, s.values.to_numpy()[:most])
        inside[at] = True
        a, size = _picked(local, begins, at)
        keep = (a >= 0) & inside[a]
        inside[at] = False
        yield at, a[keep], np.repeat(at, size)[keep]


def _named_nodes(most: int):
    def each(lists, part: pa.RecordBatch):
        names = lists[3]
        for start, s, e, (at, a, _) in zip(part.column("name"), part.column("list"), part.column("ends"), _between(lists, part.column("list"), most), strict=True):
            n, e = len(at), np.array(e.as_py())
            yield [pa.array([start.as_py()] * n, part.schema.field("name").type), names.take(pa.array(at)).combine_chunks(), pa.array(np.searchsorted(e, np.arange(n), side="right").astype(np.int32)), pa.array(np.full(n, len(s) > most)), pa.array(np.full(n, len(a), np.int64))]

    return each


def _named_edges(most: int):
    def each(lists, part: pa.RecordBatch):
        names = lists[3]
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        for start, (_, a, b) in zip(part.column("name"), _between(lists, part.column("list"), most), strict=True):
            turn = rank[a] > rank[b]
            yield [pa.array([start.as_py()] * len(a), part.schema.field("name").type), *(names.take(pa.array(np.where(turn, x, y))).combine_chunks() for x, y in ((b, a), (a, b)))]

    return each


def subgraph(starts: DataFrame, edges: DataFrame, depth: int = 3, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes(start, node, depth, truncated, edges), their edges) around each of starts(start): breadth first, within a level
    those of higher degree first, at most ``most`` nodes a start, edges once a pair. edges: how many of them
    the start has, so that to count them they need not be listed.

    Nodes are numbered by falling degree, so the smallest codes come first. Of a node's neighbours only the first 2 most + 1
    matter to a search: at most ``most`` of them are seen before, the others fill up. Starts whose best node within three
    steps is the same are dealt to blocks of about STARTS; a block gets each list of neighbours that its starts ask
    for once, and a start is one row with the codes that it has seen, so what is shuffled are lists, not the pairs of
    starts and nodes that a level meets. Edges are listed at the end of lower degree, so no list is longer than about the
    square root of twice their number.
    """
    spark, kind = edges.sparkSession, edges.select(F.least("src", "dst").alias("n")).schema["n"].dataType.simpleString()
    named = settle(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "pairs")
    nodes = settle(joins.degrees(named).orderBy(F.desc("degree"), "node").select("node", F.monotonically_increasing_id().alias("code")), "graph-nodes")
    coded = named.join(sized(nodes.select(F.col("node").alias("src"), F.col("code").alias("a"))), "src").join(sized(nodes.select(F.col("node").alias("dst"), F.col("code").alias("b"))), "dst")
    pairs = settle(coded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "coded-pairs")
    release(named)
    first = pairs.union(pairs.select("b", "a")).withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("_n") <= 2 * most + 1)
    near = settle(first.groupBy(F.col("a").alias("code")).agg(F.sort_array(F.collect_list("b")).alias("list")), "neighbours")
    ends = settle(nodes.join(pairs.groupBy(F.col("b").alias("code")).agg(F.sort_array(F.collect_list("a")).alias("list")), "code", "left").select("code", F.col("node").alias("name"), F.coalesce("list", F.array().cast("array<long>")).alias("list")), "edge-lists")
    release(pairs)

    own = settle(starts.select("start").distinct().join(sized(nodes.withColumnRenamed("node", "start")), "start", "left"), "starts")
    best = near.select("code", F.least("code", F.element_at("list", 1)).alias("best"))
    two = own.where("code is not null").select("code").distinct().join(near, "code").select(F.col("code").alias("s"), F.explode("list").alias("code")).join(sized(best), "code").groupBy(F.col("s").alias("code")).agg(F.min("best").alias("hub"))
    hubs = settle(two, "start-hubs")
    parts = sized(hubs.groupBy("hub").agg(F.ceil(F.count("*") / STARTS).alias("n")))
    block = F.xxhash64("hub", F.pmod(F.xxhash64("code"), "n")).bitwiseAND((1 << 62) - 1).alias("block")
    front = own.join(hubs.join(parts, "hub"), "code").select(block, "code", F.col("start").alias("name"), F.array("code").alias("list"), F.array(F.lit(1)).alias("ends"))
    front = settle(front, "front")
    release(nodes, hubs)

    def together(asked: DataFrame, lists: DataFrame, rows: DataFrame) -> DataFrame:
        """The lists of each block's asked(block, code), then its rows."""
        held = asked.distinct().join(lists, "code").select("block", F.lit(0).alias("kind"), "code", "name", "list", F.lit(None).cast("array<int>").alias("ends"))
        both = held.unionByName(rows.select("block", F.lit(1).alias("kind"), "code", "name", "list", "ends"))
        return both.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind")

    unnamed = near.withColumn("name", F.lit(None).cast(kind))
    for _ in range(depth):
        # a start goes on while its last level has nodes and it is not full
        before = F.when(F.size("ends") > 1, F.element_at("ends", -2)).otherwise(0)
        going = (F.size("list") <= most) & (F.element_at("ends", -1) > before)
        asked = front.where(going).select("block", F.explode(F.slice("list", before + 1, F.size("list"))).alias("code"))
        grown = together(asked, unnamed, front.where(going)).mapInArrow(_by_block(_grown(most), ["block", "code", "name", "list", "ends"]), front.schema)
        last, front = front, settle(grown.unionByName(front.where(~going)), "front")
        release(last)
    release(near)
    asked = front.select("block", F.explode(F.slice("list", 1, most)).alias("code"))
    sorted_ = together(asked, ends, front)
    lone = own.where("code is null").select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("edges"))
    found = sorted_.mapInArrow(_by_block(_named_nodes(most), ["start", "node", "depth", "truncated", "edges"]), f"start {kind}, node {kind}, depth int, truncated boolean, edges long")
    kept = sorted_.mapInArrow(_by_block(_named_edges(most), ["start", "src", "dst"]), f"start {kind}, src {kind}, dst {kind}")
    return found.unionByName(lone), kept


LISTS = 1 << 18  # of a block that ``hops`` holds at once, at most


def _named_lists(t: pa.Table):
    """(values of the lists as places in names, where each begins, the list of each name or -1, names) of lists of names."""
    t = t.combine_chunks()
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(t["list"]).to_numpy())]).astype(np.int64)
    coded = pa.chunked_array([*t["name"].chunks, *pc.list_flatten(t["list"]).chunks], t.schema.field("name").type).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    at = np.full(len(coded.dictionary), -1)
    at[codes[: t.num_rows]] = np.arange(t.num_rows)
    return codes[t.num_rows :], begins, at, coded.dictionary


def _met(rounds: int):
    """query_id, node, round of what is met from round 1 on: of the lists of the nodes of the round before, what the query has not seen."""

    def each(lists, part: pa.RecordBatch):
        values, begins, at, names = lists
        seen, last = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        first = part.column("list")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(first).to_numpy())])
        start = pc.fill_null(pc.index_in(first.flatten(), value_set=names), -1).to_numpy()
        found, sizes, held = [], [], 0

        def out():
            of = np.repeat([i for i, _, _ in sizes], [n for _, _, n in sizes])
            turns = np.repeat(np.array([r for _, r, _ in sizes], np.int32), [n for _, _, n in sizes])
            return [part.column("query_id").take(pa.array(of)), names.take(pa.array(np.concatenate(found))), pa.array(turns)]

        for i in range(part.num_rows):
            front = start[ends[i] : ends[i + 1]]
            front = front[front >= 0]
            seen[front] = True
            mine = [front]
            for r in range(1, rounds + 1):
                to = at[front]
                near, _ = _picked(values, begins, to[to >= 0])
                near = near[~seen[near]]
                last[near] = np.arange(len(near))
                front = near[last[near] == np.arange(len(near))]  # once each
                seen[front] = True
                mine.append(front)
                if len(front):
                    found.append(front)
                    sizes.append((i, r, len(front)))
                    held += len(front)
            for f in mine:
                seen[f] = False
            if held >= 1 << 17:
                yield out()
                found, sizes, held = [], [], 0
        if held:
            yield out()

    return each


def _hubs(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """node, hub of nodes(node) with a list: the node of the smallest hash within two steps."""
    near = nodes.join(lists.select("node", "list"), "node").select(F.col("node").alias("of"), F.explode(F.concat("list", F.array("node"))).alias("node"))
    return near.join(lists.select("node", "best"), "node").groupBy(F.col("of").alias("node")).agg(F.min("best")["n"].alias("hub"))


def hops(seeds: DataFrame, near: DataFrame, rounds: int, most: int) -> DataFrame:
    """query_id, node, round of what near(node, other), ``most`` rows a node at most, leads to from distinct seeds(query_id, node), each
    node in the first round that meets it; the seeds are round 0.

    Queries are sorted by hubs near their seeds, so that those that meet the same nodes are neighbours, and cut into blocks.
    Block by block, not query by query, the nodes up to the last round but one are found and each list is sent to a block
    once; a task with a block's lists goes through them for each query, so pairs of queries and nodes are not shuffled.
    A block holds LISTS lists at most.
    """
    spark = seeds.sparkSession
    node_kind, query_kind = (seeds.schema[c].dataType.simpleString() for c in ("node", "query_id"))
    each = F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("n"))
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    lists = settle(near.groupBy("node").agg(F.collect_set("other").alias("list"), F.min(each).alias("best")).withColumn("best", F.least("best", own)), "lists")

    hub = settle(_hubs(seeds.select("node").distinct(), lists), "hubs")
    order = [hub.select("node", F.col("hub").alias("hub0"))]
    for i in (1, 2):  # the hubs of hubs bring queries together that share none
        hub = settle(_hubs(hub.select(F.col("hub").alias("node")).distinct(), lists), "hubs")
        order.append(hub.select(F.col("node").alias(f"hub{i - 1}"), F.col("hub").alias(f"hub{i}")))
    placed = seeds.where("node is not null").join(order[0], "node", "left").join(order[1], "hub0", "left").join(order[2], "hub1", "left")
    by_query = placed.groupBy("query_id").agg(F.min(F.struct("hub2", "hub1", "hub0")).alias("hubs"), F.collect_list("node").alias("list"))
    by_query = settle(by_query.orderBy("hubs", "query_id").withColumn("at", F.monotonically_increasing_id()), "queries")
    widest, n = by_query.agg(F.max(F.size("list")), F.count("*")).first()
    fit = max(1, LISTS // (max(1, widest or 1) * sum(most**i for i in range(rounds))))
    per = max(1, min(fit, STARTS, max(32, n // partitions(spark))))
    queries = by_query.select(F.expr(f"at div {per}").alias("block"), "query_id", "list")

    asked = settle(queries.select("block", F.explode("list").alias("node")).distinct(), "asked")
    level = asked
    for _ in range(1, rounds):
        level = level.join(lists.select("node", "list"), "node").select("block", F.explode("list").alias("node")).distinct()
        level = settle(level.join(asked, ["block", "node"], "left_anti"), "asked")
        asked = asked.unionByName(level)
    held = asked.join(lists, "node").select("block", F.lit(0).alias("kind"), F.lit(None).cast(query_kind).alias("query_id"), F.col("node").alias("name"), "list")
    rows = queries.select("block", F.lit(1).alias("kind"), "query_id", F.lit(None).cast(node_kind).alias("name"), "list")
    sorted_ = held.unionByName(rows).repartition(partitions(spark), "block").sortWithinPartitions("block", "kind")
    met = sorted_.mapInArrow(_by_block(_met(rounds), ["query_id", "node", "round"], _named_lists), f"query_id {query_kind}, node {node_kind}, round int")
    return seeds.select("query_id", "node", F.lit(0).alias("round")).unionByName(met)


def apply_edits(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after edits(op, key, name, description): create, edit, rename (edges follow) and delete (with
    the edges at it). Nodes have (name, description)."""
    gone = edits.where("op = 'delete'").select(F.col("key").alias("name"))
    renamed = edits.where("op = 'rename'").select(F.col("key").alias("old"), F.col("name").alias("canonical"))
    changed = edits.where("op in ('edit', 'create')").select(F.col("key").alias("name"), "description")
    left = nodes.join(gone, "name", "left_anti").join(changed, "name", "left_anti").unionByName(changed)
    left = left.join(renamed.withColumnRenamed("old", "name"), "name", "left").select(F.coalesce("canonical", "name").alias("name"), "description")
    e = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti").select(*edges.columns)
    return left, joins.rewrite_ends(e, renamed)


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Undirected edges(src, dst, weight, keywords, description, chunk_id) after merging nodes by mapping(old,
    canonical): self-loops go, parallel ones have the largest weight and the unions of the rest."""
    moved = joins.rewrite_ends(edges, mapping).where("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    words = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.transform(F.split("keywords", ","), F.trim))), lambda x: x != "")))
    out = moved.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.array_join(words, ",").alias("keywords"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"), F.array_sort(F.collect_set("chunk_id")).alias("sources"))
    return out.withColumnsRenamed({"a": "src", "b": "dst"})


def delete_documents(mentions: DataFrame, chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, action, sources; rebuilt nodes) after docs(doc_id) go: a name without other chunks is deleted, one that
    lost some is rebuilt from the rest."""
    removed = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
    owned = mentions.groupBy("name").agg(F.collect_set("chunk_id").alias("sources")).select(F.col("name").alias("key"), "sources")
    plan = ranking.source_difference(owned, removed.select(F.col("chunk_id").alias("source"))).withColumnRenamed("key", "name")
    touched = mentions.join(plan.where("action = 'rebuild'").select("name"), "name", "left_semi")
    return plan, aggregates.rebuilt_nodes(touched, removed)[0]


def load_custom(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of prepared tables joined with chunks(source_id, chunk_id); no type, or no chunk: UNKNOWN; ends
    that are no entities are created."""
    c = chunks.select("source_id", "chunk_id")
    nodes = entities.join(c, "source_id", "left").select("name", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), "description", F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("chunk_id"))
    edges = relations.join(c, "source_id", "left").select("src", "dst", "description", "keywords", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("chunk_id"))
    new = aggregates.created_endpoints(edges, nodes).select("name", "type", F.lit("UNKNOWN").alias("description"), F.lit("UNKNOWN").alias("chunk_id"))
    return nodes.unionByName(new), edges


def local_retrieval(queries: DataFrame, entities: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(entities by similarity with degree, their edges by rank): queries(query_id, embedding), entities(id,
    embedding), edges(src, dst, weight) over ids."""
    d = joins.degrees(edges)
    hits = vectors.topk(queries, entities, k)
    found = hits.join(d.withColumnRenamed("node", "id"), "id", "left").select("query_id", "rank", "id", "score", F.coalesce("degree", F.lit(0)).alias("degree"))
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    seeds = hits.select("query_id", F.col("id").alias("node"))
    at = seeds.join(e.withColumn("node", F.col("src")), "node").unionByName(seeds.join(e.withColumn("node", F.col("dst")), "node")).select("query_id", "src", "dst", "weight").distinct()
    ranked = at.join(joins.edge_degrees(e.select("src", "dst"), edges), ["src", "dst"])
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("degree"), F.desc("weight"), "src", "dst"))
    return found, ranked.withColumn("rank", order)


def global_retrieval(queries: DataFrame, relations: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(relations(id, src, dst, embedding) by similarity, their distinct ends in the order of first use)."""
    hits = vectors.topk(queries, relations, k).join(relations.select("id", "src", "dst"), "id")
    ends = hits.select("query_id", "rank", F.posexplode(F.array("src", "dst")).alias("side", "node"))
    first = ends.groupBy("query_id", "node").agg(F.min(F.struct("rank", "side")).alias("o"))
    return hits, first.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("o", "node"))).select("query_id", "node", "position")


def mix_context(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """query_id, id, position: ranked lists(query_id, id, rank, tokens), such as local and global hits and chunks, each
    within its own token budget, then in turns; a repeated id counts where it comes first."""
    out = None
    for i, (rows, budget) in enumerate(parts):
        one = ranking.within_budget(rows, ["query_id"], ["rank", "id"], "tokens", budget).select("query_id", F.lit(i).alias("list"), "rank", "id")
        out = one if out is None else out.unionByName(one)
    return ranking.interleave(out)


def effective_mode(queries: DataFrame) -> DataFrame:
    """queries(query_id, mode, low, high) with the mode that their keywords allow: none: empty; local and hybrid without
    low-level ones: global; global and hybrid without high-level ones: local."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    mode = F.when(~has("low") & ~has("high"), "empty").when(~has("low") & F.col("mode").isin("local", "hybrid", "mix"), "global").when(~has("high") & F.col("mode").isin("global", "hybrid", "mix"), "local").otherwise(F.col("mode"))
    return queries.withColumn("effective", mode)


def count_mentions(graph: DataFrame, triples: DataFrame, rows: int | None = None) -> DataFrame:
    """graph(src, relation, dst, mentions) after triples(src, relation, dst) are added, one mention each. rows: of
    both at most, where that is known."""
    key = ["src", "relation", "dst"]
    both = graph.select(*key, "mentions").unionByName(triples.select(*key, F.lit(1).cast("long").alias("mentions")))
    return spread(both, *key, rows=rows).groupBy(*key).agg(F.sum("mentions").alias("mentions"))


def dedup_rounds(rows: DataFrame, key: str, merge: Callable[[DataFrame], DataFrame], rounds: int = 10) -> tuple[DataFrame, int]:
    """Merge duplicates until no key repeats, or rounds are up; a merge may return split rows. (rows, rounds used)."""
    for n in range(rounds):
        repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
        if repeated.isEmpty():
            return rows, n
        merged = merge(rows.join(repeated, key, "left_semi"))
        rows = settle(rows.join(repeated, key, "left_anti").unionByName(merged.select(*rows.columns)), "dedup-round")
    return rows, rounds


def incremental_merge(new: DataFrame, old: DataFrame, k: int, least: float) -> DataFrame:
    """Id, group, action: rows of new and old(id, embedding) after new ones met their k most similar old ones; groups
    that share a row are one. Old rows of a group of two and more are to be replaced, lone new rows inserted."""
    hits = vectors.topk(new.select(F.col("id").alias("query_id"), "embedding"), old, k, cosine=True).where(F.col("score") >= least)
    groups = components(settle(hits.select(F.col("query_id").alias("a"), F.col("id").alias("b")), "overlaps"))
    ids = new.select("id", F.lit("new").alias("side")).unionByName(old.select("id", F.lit("old").alias("side")))
    out = ids.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "side", F.coalesce("component", "id").alias("group"), F.col("component").isNotNull().alias("joined"))
    return out.select("id", "group", F.when(F.col("joined"), "merge").when(F.col("side") == "new", "insert").otherwise("keep").alias("action"))


def chunk_matches(similar: DataFrame) -> DataFrame:
    """Conflict-free pairs of similar(a, b, score) chunks of different sources: each the other's best (ties: smaller id)."""
    both = similar.select("a", "b", "score").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"), F.max("score").alias("score"))
    return best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select("x.a", "x.b", "x.score")


def tree_nodes(paths: DataFrame) -> DataFrame:
    """Path, parent, name, depth of all distinct prefixes of paths(path array)."""
    prefix = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    joined = lambda n: F.array_join(F.slice("path", F.lit(1), n), "/")
    return prefix.select(joined(F.col("depth")).alias("path"), F.when(F.col("depth") > 1, joined(F.col("depth") - 1)).alias("parent"), F.get("path", F.col("depth") - 1).alias("name"), "depth").distinct()


def overview(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(what, name, n): the numbers of nodes and edges, of nodes by type, and the hubs. Of nodes with one name the last counts."""
    one = nodes.groupBy("name").agg(F.max_by("type", "position").alias("type"))
    counts = one.agg(F.lit("count").alias("what"), F.lit("nodes").alias("name"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("count").alias("what"), F.lit("edges").alias("name"), F.count("*").alias("n")))
    kinds = one.groupBy(F.coalesce("type", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "name", "n")
    hub = ranking.hubs(joins.degrees(edges), one.select(F.col("name").alias("node")), top).select(F.lit("hub").alias("what"), F.col("node").alias("name"), F.col("degree").alias("n"))
    return counts.unionByName(kinds).unionByName(hub)


def delete_triples(edges: DataFrame, gone: DataFrame, scope: list[str]) -> DataFrame:
    """edges(scope, src, relation, dst) without the triples of a scope."""
    return edges.join(gone.select(*scope, "src", "relation", "dst").distinct(), [*scope, "src", "relation", "dst"], "left_anti").select(*edges.columns)
