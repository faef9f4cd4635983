"""The base spans of the secret query against a scan that goes character by character."""

import hashlib
import random

from tabulon.llm import secret_scan

KEYS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
UPPER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def assign_at(text, at):
    """(end, length of the value) of an assignment that begins here."""
    for word in KEYS:
        if ascii_lower(text[at:at + len(word)]) == word:
            i = at + len(word)
            i += text[i:i + 1] in ("'", '"') and bool(text[i:i + 1])
            i = run_of(text, i, {" "})
            if text[i:i + 1] not in (":", "=") or not text[i:i + 1]:
                continue
            i = run_of(text, i + 1, {" "})
            i += text[i:i + 1] in ("'", '"') and bool(text[i:i + 1])
            end = run_of(text, i, VALUE)
            if end > i:
                return end, end - i
    return None


def base_spans(text):
    found, i = [], 0
    while i < len(text):
        hit = assign_at(text, i)
        if hit and hit[1] >= 8:
            found.append((i, 0, hit[0]))
        i = hit[0] if hit else i + 1
    for kind, begin, allowed, least in ((1, "AKIA", UPPER, 16), (2, "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            end = run_of(text, i + len(begin), allowed) if text.startswith(begin, i) else i
            hit = end > i + len(begin)
            if hit and end - i >= least:
                found.append((i, kind, end))
            i = end if hit else i + 1
    return sorted(found)


def texts():
    rng = random.Random(9)
    bits = [*KEYS, "PassWord", "API_Key", "toKen", "ſecret", "toKen", "=", ":", " = ", ": ", "'", '"', " ", "\n", "\t", "é", "😀", "abc12345", "x" * 7,
            "AKIA", "AKIAABCDEFGH1234", "AKIA0123456789", "0123456789abcdef" * 2, "deadbeef" * 4, "f" * 31, "DEADBEEF", "==", "/+._-", "AKIAAKIA", "secret_token"]
    return [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)), "x " * 40_000 + "token=abcdefgh1 " + "y" * 70_000]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in secret_scan.op8(spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == len(rows)
    names, counts = ["assign", "access", "hex"], [0, 0, 0]
    for i, text in rows:
        want = base_spans(text or "")
        n = [sum(k == kind for _, k, _ in want) for kind in range(3)]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == n, text
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
        counts = [a + b for a, b in zip(counts, n)]
    assert min(counts) > 20
