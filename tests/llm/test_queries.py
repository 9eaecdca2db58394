"""Every registered query on whole tables, against brute force or SQL."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from tests.conftest import SF_CHECK
from workload.check import connect, ordered

from gridweave.llm import packing
from gridweave.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table():
    return lambda name: pq.read_table(f"{SF_CHECK}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    got = {}

    def run(name):
        if name not in got:
            got[name] = QUERIES[name](spark, SF_CHECK).collect()
        return got[name]

    return run


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ours = ordered(QUERIES[name](spark, SF_CHECK).toPandas())
    theirs = ordered(connect(SF_CHECK).execute(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c


def test_op1(table, result):
    got = {r["doc_id"]: r for r in result("op1_rules")}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    good = [x["doc_id"] for x in table("labels") if x["quality"] == 1 and not got[x["doc_id"]]["base_failed"]]
    bad = [x["doc_id"] for x in table("labels") if x["quality"] == 0]
    assert sum(got[i]["kept"] for i in good) >= 0.99 * len(good)
    assert sum(got[i]["kept"] for i in bad) <= 0.2 * len(bad)


def test_op2(table, result):
    import base64

    pages = table("pages")
    last = {}
    for p in pages:
        payload = (p["html"] or "").encode()
        last[payload] = max(last.get(payload, -1), p["page_id"])
    want = set()
    for p in pages:
        payload = (p["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = last[payload] == p["page_id"]
        want.add((p["page_id"], len(payload), digest, "response" if first else "revisit", None if first else last[payload]))
    got = [
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in result("op2_warc")
    ]
    assert len(got) == len(pages)
    assert set(got) == want


def test_op3(table, result):
    got = {r["doc_id"]: r for r in result("op3_quality")}
    assert len(got) == len(table("documents"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == held_out(i) for i, r in got.items())
    tested = [(x["quality"], got[x["doc_id"]]["predicted"]) for x in table("labels") if held_out(x["doc_id"])]
    assert len(tested) > 50
    assert np.mean([a == b for a, b in tested]) >= 0.95


def test_op4(table, result):
    got = {r["doc_id"]: r for r in result("op4_language")}
    docs = table("documents")
    assert len(got) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == held_out(i) for i, r in got.items())
    assert {r["lang_pred"] for r in got.values()} <= {d["lang"] for d in docs} | {"und"}
    tested = [(d["lang"], got[d["doc_id"]]["lang_pred"]) for d in docs if held_out(d["doc_id"]) and len(d["text"] or "") > 50]
    assert np.mean([a == b for a, b in tested]) >= 0.95


def brute_secrets(text):
    kinds = {
        "assign": re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    out = []
    for place, (kind, pattern) in enumerate(kinds.items()):
        for m in pattern.finditer(text):
            long = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
            if long[kind](m):
                out.append((m.start(), place, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_op5(table, result):
    got = {r["doc_id"]: r for r in result("op5_secrets")}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs:
        base = brute_secrets(d["text"] or "")
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")
        ]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(","))
    assert sum(r["n_assign"] for r in got.values()) > 5


def test_op6_takes_near_the_target(result):
    rows = result("op6_mixing")
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), some in by.items():
        assert target <= 3 * size + 1e-6
        largest = max(r["size"] for r in some)
        assert abs(sum(r["taken"] for r in some) - target) <= largest + 1
    assert math.isclose(sum(t for _, t in by), sum(r["size"] for r in rows), rel_tol=1e-9)


def test_op7(table, result):
    rows = {r["vec_id"]: r for r in table("embeddings")}
    unit = {i: np.array(r["embedding"], float) / np.linalg.norm(r["embedding"]) for i, r in rows.items()}
    pairs, links = [], dict.fromkeys(rows, 0)
    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if rows[a]["label"] == rows[b]["label"] and unit[a] @ unit[b] >= 0.98:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    want = roots(ids, pairs)
    got = {r["vec_id"]: r for r in result("op7_vectors")}
    assert len(got) == len(rows)
    for i in ids:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], want[i], want[i] == i)


def brute_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op8(table, result):
    prints = {d["doc_id"]: brute_fingerprint(d["text"]) for d in table("documents")}
    ids = sorted(prints)
    pairs = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    want = roots(ids, pairs)
    got = {r["doc_id"]: r for r in result("op8_simhash")}
    assert len(got) == len(ids)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", want[i]) for i in ids
    }
    assert len(set(want.values())) < len(ids)


def test_op9(table, result):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by, at = {}, {}
    for r in result("op9_packing"):
        by.setdefault(r["doc_id"], []).append(r)
        at.setdefault(r["sequence_id"], []).append(r)
    docs = table("documents")
    assert set(by) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (start, len(ids))
            assert zlib.crc32(ids[start : start + r["length"]].tobytes()) == r["ids_crc32"]
            start += r["length"]
        assert start == len(ids)
    for rows in at.values():
        assert len(rows) == 1 and rows[0]["offset"] == 0
        assert rows[0]["length"] <= 4096 and rows[0]["length"].bit_count() == 1
    lengths = [at[i][0]["length"] for i in range(len(at))]
    assert lengths == sorted(lengths, reverse=True)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute_identifiers(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
    }
    return [
        (kind, *m.span())
        for kind, (pattern, passes) in kinds.items()
        for m in re.finditer(pattern, text)
        if passes(m[0], re.sub("[^0-9]", "", m[0]))
    ]


def test_op10(table, result):
    got = {r["doc_id"]: r for r in result("op10_pii")}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs:
        base = brute_identifiers(d["text"] or "")
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")
        ]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(","))
    assert sum(r["n_email"] for r in got.values()) > 5
