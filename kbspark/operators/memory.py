"""Scoped memories with an append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.operators import keyword, vectors

SCOPES = ("user_id", "agent_id", "run_id")
#: Payload keys that are columns of their own.
PROMOTED = ("user_id", "agent_id", "run_id", "actor_id", "role", "created_at", "updated_at", "hash", "data")


def scope_filter(metadata: str = "metadata", **wanted: str) -> Column:
    """Equality on scope columns and metadata keys; one scope id at least is needed."""
    if not any(wanted.get(s) for s in SCOPES):
        raise ValueError(f"one of {', '.join(SCOPES)} is needed")
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out &= (F.col(name) if name in (*SCOPES, "actor_id", "role") else F.element_at(F.col(metadata), name)) == F.lit(value)
    return out


def promote(df: DataFrame, payload: str, keys: tuple[str, ...] = PROMOTED) -> DataFrame:
    """Known keys of a payload map as columns, the others as metadata (null if there are none)."""
    rest = F.map_filter(payload, lambda k, _: ~k.isin(*keys))
    return df.select(*[c for c in df.columns if c != payload], *[F.element_at(payload, k).alias(k) for k in keys], F.when(F.size(rest) > 0, rest).alias("metadata"))


def flatten_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, text: ``role: content`` lines of system, user and assistant in order."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    kept = messages.where(F.col("role").isin("system", "user", "assistant"))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("text"))


def usable_messages(messages: DataFrame) -> DataFrame:
    """No system messages, none without role or text; role kept, actor set."""
    return messages.where("role is not null and role <> 'system' and text is not null and trim(text) <> ''").withColumn("actor_id", F.col("role"))


def documents_by_status(docs: DataFrame, status: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """P25: status rows by status or by doc_id, with defaults for what is missing."""
    out = docs.where(F.col("status") == status) if status else docs
    out = out.join(ids.select("doc_id").distinct(), "doc_id", "left_semi") if ids is not None else out
    return out.withColumns({"chunks_count": F.coalesce("chunks_count", F.lit(0)), "error": F.coalesce("error", F.lit(""))})


def add_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: (memories, history): one memory a usable message of messages(conv_id, turn, role, text); its id is a hash of scope,
    text and place, so that a run can be repeated."""
    rows = usable_messages(messages).select(F.left(F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 256), F.lit(32)).alias("memory_id"), F.col("conv_id").cast("string").alias("run_id"), "role", "actor_id", F.col("text").alias("memory"), F.md5("text").alias("hash"), F.col("turn").cast("long").alias("at"))
    history = rows.select("memory_id", F.lit(None).cast("string").alias("old_memory"), F.col("memory").alias("new_memory"), F.lit("ADD").alias("event"), "at", F.lit(False).alias("is_deleted"))
    return rows, history


def recall_candidates(facts: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """M2: scope, id, alias: the k nearest memories(id, scope, embedding) of each of facts(query_id, scope, embedding) within
    its scope, distinct in a scope, with short numbers from 0."""
    hits = vectors.topk(facts, memories, k, cosine=True, scope="scope")
    ranked = hits.join(facts.select("query_id", "scope"), "query_id")
    return ranked.select("scope", "id").distinct().withColumn("alias", F.row_number().over(W.partitionBy("scope").orderBy("id")) - 1)


def apply_events(state: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M3: (state, history, skipped) after events(seq, memory_id, event, text): ADD, UPDATE, DELETE, NONE.

    state(memory_id, memory, created_at, updated_at) holds times as sequence numbers. The last event of an id
    counts for the state, all for the history. Empty texts of ADD and UPDATE are skipped; so are UPDATE and
    DELETE of ids that neither the state nor an ADD knows. UPDATE keeps created_at."""
    live = events.where("event in ('ADD', 'UPDATE', 'DELETE')")
    blank = live.where("event <> 'DELETE' and trim(coalesce(text, '')) = ''")
    rest = live.where("event = 'DELETE' or trim(coalesce(text, '')) <> ''")
    known = state.select("memory_id").union(rest.where("event = 'ADD'").select("memory_id")).distinct()
    good = rest.join(known, "memory_id", "left_semi")
    skipped = blank.select("seq", "memory_id", F.lit("empty").alias("reason")).unionByName(rest.join(known, "memory_id", "left_anti").select("seq", "memory_id", F.lit("unknown").alias("reason")))
    last = good.groupBy("memory_id").agg(F.max_by(F.struct("event", "text", "seq"), "seq").alias("l"), F.min(F.when(F.col("event") == "ADD", F.col("seq"))).alias("born"))
    both = state.join(last, "memory_id", "full")
    new = both.where("l is null or l.event <> 'DELETE'").select("memory_id", F.coalesce("l.text", "memory").alias("memory"), F.coalesce("created_at", "born").alias("created_at"), F.coalesce("l.seq", "updated_at").alias("updated_at"))
    w = W.partitionBy("memory_id").orderBy("seq")
    before = F.lag("new_memory").over(w)
    rows = good.join(state.select("memory_id", F.col("memory").alias("_m")), "memory_id", "left").withColumn("new_memory", F.when(F.col("event") != "DELETE", F.col("text")))
    history = rows.withColumn("old_memory", F.when(F.row_number().over(w) == 1, F.col("_m")).otherwise(before)).select("seq", "memory_id", "old_memory", "new_memory", "event", (F.col("event") == "DELETE").alias("is_deleted"))
    return new, history, skipped


def search(queries: DataFrame, memories: DataFrame, k: int, floor: float | None = None, **scope: str) -> DataFrame:
    """M4: the k most similar memories of a scope, by cosine, above a floor."""
    inside = memories.where(scope_filter(**scope))
    return vectors.topk(queries, inside, k, cosine=True, floor=floor).join(inside.select("id", "memory"), "id")


def search_with_graph(queries: DataFrame, memories: DataFrame, triples: DataFrame, k: int, floor: float | None = None, most: int = 5, **scope: str) -> DataFrame:
    """M4, both sides: query_id, side, id, score, rank, text for queries(query_id, embedding, text).

    ``vector``: what ``search`` finds; ``graph``: the ``most`` triples(id, source, relation, destination) of the scope's
    ids by BM25 whose counts are those of the scope; other conditions bind memories only. A query without text
    has no triple.
    """
    near = search(queries.select("query_id", "embedding"), memories, k, floor, **scope).select("query_id", F.lit("vector").alias("side"), "id", "score", "rank", F.col("memory").alias("text"))
    inside = triples.where(scope_filter(**{name: value for name, value in scope.items() if name in SCOPES}))
    shown = inside.select("id", F.concat_ws(" -- ", "source", "relation", "destination").alias("text"))
    told = keyword.triple_topk(queries.where("text is not null").select("query_id", "text"), inside, most).join(shown, "id")
    return near.unionByName(told.select("query_id", F.lit("graph").alias("side"), "id", "score", "rank", "text"))


def list_memories(memories: DataFrame, limit: int = 100, **scope: str) -> DataFrame:
    """M5: memories of a scope, oldest first."""
    return memories.where(scope_filter(**scope)).orderBy("created_at", "memory_id").limit(limit)


def delete_in_scope(memories: DataFrame, at: int, **scope: str) -> tuple[DataFrame, DataFrame]:
    """M6: (what stays, history of what goes)."""
    inside = F.coalesce(scope_filter(**scope), F.lit(False))
    gone = memories.where(inside).select("memory_id", F.col("memory").alias("old_memory"), F.lit(None).cast("string").alias("new_memory"), F.lit("DELETE").alias("event"), F.lit(at).cast("long").alias("at"), F.lit(True).alias("is_deleted"))
    return memories.where(~inside), gone


def state_at(history: DataFrame, at) -> DataFrame:
    """M7: memory_id, memory as of a time: the last history row up to it, if it is not a deletion."""
    last = history.where(F.col("seq") <= at).groupBy("memory_id").agg(F.max_by(F.struct("new_memory", "is_deleted"), "seq").alias("l"))
    return last.where("not l.is_deleted").select("memory_id", F.col("l.new_memory").alias("memory"))


def gate_entries(new: DataFrame, old: DataFrame, same: float = 0.95, close: float = 0.8) -> DataFrame:
    """M8: id, nearest, score, decision of new entries whose id is not stored: remain (the same), update (close) or add."""
    fresh = new.join(old.select("id"), "id", "left_anti")
    hit = vectors.nearest(fresh.select(F.col("id").alias("query_id"), "embedding"), old)
    out = fresh.select("id").join(hit.select(F.col("query_id").alias("id"), F.col("id").alias("nearest"), "score"), "id", "left")
    return out.withColumn("decision", F.when(F.col("score") >= same, "remain").when(F.col("score") >= close, "update").otherwise("add"))
