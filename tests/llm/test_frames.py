import hashlib
import random
import re

import zstandard
from common import AWKWARD, frame, rows, sha
from pyspark.sql import functions as F

from kbspark.llm.frames import Frames, arranged, compressed, fill_in_middle, restored, store, texts, units

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def cases():
    r = random.Random(11)
    bits = ["a", "bc", " ", "  ", "\n", "\t", "é", "\U0001f600", "\x0b", "\x1f", "\xa0", "<", "P>", "<P", ">", "<S", "M>"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(400)]


def test_brute(spark):
    long = [" ".join(f"wörd{k}" for k in range(60_000)), " " * 200_000, "é" * 150_000, "x" * 65_535 + "é y", "a <P> b" * 3, " lead", "trail ", "x" * 65_534 + "<S>" + "y" * 70_000]
    all_texts = [*AWKWARD, *cases(), *long, *long, *long]
    docs = frame(spark, all_texts)
    kept = store(docs)
    made = fill_in_middle(kept)
    found, outputs, back = rows(made.drop("frames")), rows(texts(made)), rows(texts(kept))
    forms = set()
    for k, t in enumerate(all_texts):
        n, form, p, m, out = brute(k, t)
        r = found[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(out), sha(t or "")), t[:50]
        assert outputs[k]["text"] == out and back[k]["text"] == (t or "") and r["size"] == len(out.encode())
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle(store(frame(spark, []))).count() == 0


def test_units_and_frames_opened(spark):
    text = " ".join(f"word{k}" for k in range(100_000))
    got = rows(units(store(frame(spark, [text, "", "a b c"])), F.lit(1), F.lit(3)))
    assert [got[k]["text"] for k in range(3)] == [" word1 word2", "", " b c"]
    frames, n, size = compressed(iter([text.encode()]), zstandard.ZstdCompressor())
    own = Frames(frames, size, zstandard.ZstdDecompressor())
    assert len(frames) > 10 and n == 100_000
    assert own.seek(50_000, n)[1] == sum(len(f"word{k}") + (k > 0) for k in range(50_000))
    assert own.opened == 1  # a cut decompresses one frame


def test_frames_of_any_size_round_trip():
    r = random.Random(1)
    zip_, unzip = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    for t in cases():
        data, u = t.encode(), UNIT.findall(t)
        for size in (4, 7, 64):
            frames, n, total = compressed((data[k : k + 3] for k in range(0, len(data), 3)), zip_, size)
            own = Frames(frames, total, unzip)
            assert n == len(u) and b"".join(own.read(0, total)) == data
            for k in range(n + 1):
                head = "".join(u[:k])
                assert own.seek(k, n) == (len(head.encode()), len(head))
            if n and not any(m in t for m in ("<P>", "<S>", "<M>")):
                a, b = sorted(own.seek(r.randrange(n + 1), n)[0] for _ in range(2))
                for form in ("psm", "spm"):
                    out, _, length = compressed(arranged(own, form, a, b), zip_, size)
                    assert b"".join(restored(Frames(out, length, unzip), form)) == data


def test_repeated_and_null_ids(spark):
    data = [(1, "one two three"), (1, "one two three"), (None, "a b"), (7, None)]
    out = fill_in_middle(store(spark.createDataFrame(data, "doc_id int, text string")), rate=100, with_frames=False).collect()
    assert sorted((r["doc_id"] or 0, r["n"]) for r in out) == [(0, 2), (1, 3), (1, 3), (7, 0)]
    assert all(r["restored_sha256"] == sha(t or "") for r, (_, t) in zip(sorted(out, key=lambda r: r["doc_id"] or 0), sorted(data, key=lambda d: d[0] or 0), strict=True))
