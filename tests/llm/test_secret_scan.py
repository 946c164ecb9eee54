import random
import re
import zlib

from common import AWKWARD, frame, rows, sha

from kbspark.llm.secret_scan import DIGITS, find, redact, scan_secrets

RULES = {
    "assign": (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[1]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, (p, ok)) in enumerate(RULES.items()) for m in p.finditer(text) if ok(m))
    return [(a, list(RULES)[k], b) for a, k, b in found]


def github(body):
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return "ghp_" + body + out


def cases():
    r = random.Random(3)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ": ", "'", '"', " ", "akia", "AKIA", "deadbeef", "0123456789abcdef", "ABCDEF", "é", "ß", "x", "ſ", "K", "hunter22", "=token=", "_", "\n"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(600)]


def test_brute(spark):
    texts = [*AWKWARD, *cases(), "a" * 31, "a" * 32, "0" * 40 + "G" + "f" * 33, "tokentoken=tokentoken=abcdefgh", "AKIA" * 9, "pass" + "password=" * 40]
    found = rows(scan_secrets(frame(spark, texts)))
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert found[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, k, b in want)), t
        assert found[i]["n_hex"] == sum(k == "hex" for _, k, _ in want)
    assert scan_secrets(frame(spark, [])).count() == 0


def test_checksum():
    good = github("a1B2" * 7 + "xy")
    assert [f[1] for f in find(f"see {good}.")] == [3]
    assert not find(f"see {good[:-1]}{'0' if good[-1] != '0' else '1'}.")
    assert redact(f"see {good}.") == "see [secret]."


def test_int_null_repeated_ids_and_a_long_text(spark):
    rows_ = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "AKIA" + "B" * 16), (4, "token=abcdefgh " * 70_000), (5, None)]
    out = scan_secrets(spark.createDataFrame(rows_, "doc_id int, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"]) for r in out) == [(0, 0, 1), (1, 1, 0), (1, 1, 0), (4, 70_000, 0), (5, 0, 0)]
