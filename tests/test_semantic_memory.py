from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from kbspark.operators import chunking


def test_chunks_are_handed_on_by_size(spark):
    """Of a batch of long texts, a task holds the chunks of a few at once; the chunks are those of each text."""
    texts = [None, "", "  "] + [f"word{k} " * 2000 for k in range(150)]
    t = pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    kept = {}
    docs = SimpleNamespace(sparkSession=spark, select=lambda *_: docs, mapInArrow=lambda f, _: kept.update(arrow=f), mapInPandas=lambda f, _: kept.update(pandas=f))
    chunking.semantic_chunks(docs, 40)
    sizes, rows = [], 0
    given = t.to_batches() if "arrow" in kept else [t.to_pandas()]
    for out in kept.get("arrow", kept.get("pandas"))(iter(given)):
        out = out if isinstance(out, pd.DataFrame) else out.to_pandas()
        assert list(out.columns) == ["doc_id", "chunk_order", "start", "end", "text"]
        own = out[out["doc_id"] == 9]
        assert not len(own) or (" ".join(own["text"]).split() == texts[9].split() and (own["start"].to_numpy()[1:] == own["end"].to_numpy()[:-1]).all())
        sizes.append(out["text"].str.len().sum())
        rows += len(out)
    assert rows == 150 * 50 and max(sizes) < 1_200_000, (rows, max(sizes))
