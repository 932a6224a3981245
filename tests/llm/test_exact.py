"""Operators whose results are fixed, against the libraries or brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tieout.llm import embedding_links, lattice_lm, piece_codec, quality_rules, secret_scan, simhash, suffix_dedup, token_counts
from tieout.llm.common import held_out

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "The  cat\n\n sat.\tIt's 3½ <|endoftext|>x", "é" * 70, "日本 ▁▁x\x00", "a" * 3000, "word " * 400, "the the", "the the"]


def docs(spark, texts, extra=True):
    """Texts with ids; columns that operators use inside themselves stand beside."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({"id": F.lit("x"), "_id": F.lit(1), "words": F.lit(2), "h": F.lit(3)}) if extra else df


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(spark):
    got, t = by_id(token_counts.token_counts(docs(spark, ODD), BPE)), Tokenizer.from_file(BPE)
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs(spark, []), BPE).count() == 0


def test_piece_codec(spark):
    got, p = by_id(piece_codec.encode_decode(docs(spark, ODD), PIECES, keep=True)), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate(ODD):
        ids = p.encode(text or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].decoded == p.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
    random.seed(0)
    e = piece_codec.encoder(PIECES)
    for _ in range(2000):
        s = "".join(random.choice([" ", "  ", "▁", "a", "the", "ing", "é", "\n", "9", "<s>", "𝒳", "日", "://"]) for _ in range(random.randint(0, 14)))
        assert e.encode(s) == array("I", p.encode(s, add_bos=True, add_eos=True)).tobytes()


def brute_spans(s):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(s) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 24]
    spans.sort()
    return spans


def brute_entropy(s, base):
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", s):
        w = m[0]
        if re.search(secret_scan.ALLOWED, w):
            continue
        kind, bits = (3, secret_scan.HEX_BITS) if re.fullmatch("[0-9a-fA-F]+", w) else (4, secret_scan.MIXED_BITS)
        runs = []
        for i in range(len(w) - 19):
            c = Counter(w[i : i + 20])
            if -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= bits - 1e-6:
                if runs and m.start() + i <= runs[-1][1]:
                    runs[-1][1] = m.start() + i + 20
                else:
                    runs.append([m.start() + i, m.start() + i + 20])
        for a, b in runs:  # what base spans leave of it
            free = [i for i in range(a, b) if not any(x <= i < y for x, _, y in base)]
            pieces = [(i, next(j for j in range(i, b + 1) if j not in free)) for i in free if i - 1 not in free]
            found += [(i, kind, j) for i, j in pieces if not re.search(secret_scan.ALLOWED, s[i:j])]
    return found


def test_secret_scan(spark):
    texts = [None, "", "Password = 'abc123.x' token:ab api_key=token:abcdef", "é AKIA" + "B2" * 8 + " AKIAX " + "0af" * 9, "x Zk8Qw3+Lr7Tn1Vb5Yh9Mp2Xs4Cd6 y", "deadBEEF" + "0123" * 5, "0a1B2c3D4e5F6a7B8c9D0e1F",
             "550e8400-e29b-41d4-a716-446655440000", "2024-01-02T03:04:05-abcdefgh99", "src/main/words/only/file12", "q7Kd" * 12, "tokens=" + "aB3" * 3000, "passwordpassword: secret=aaaaaa1"]
    got = by_id(secret_scan.secret_spans(docs(spark, texts)))
    names = secret_scan.KINDS
    listed = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    for i, text in enumerate(texts):
        s = text or ""
        base = brute_spans(s)
        assert got[i].base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert got[i].spans == listed(sorted(base + brute_entropy(s, base))), s[:60]
    assert "entropy_mixed" in got[4].spans and "entropy" not in got[7].spans and "entropy" not in got[9].spans


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b", 21), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars int").withColumn("_spans", F.lit("clash"))
    got = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert (got[1].text, got[1].n_chars) == ("a [secret] b", 12) and got[2].text is None and got[3].text == "clean" and got[1]._spans == "clash"


def test_simhash(spark):
    random.seed(3)
    base = [" ".join(random.choice(["ab", "cd", "ef", "GH", "ij"]) for _ in range(60)) for _ in range(3)]
    texts = [None, "", "one", "One", "a b c", "a b c d e"] + base * 2 + [b + " tail" for b in base] + [b.replace("ab", "xy", 1) for b in base]
    got = by_id(simhash.simhash_groups(docs(spark, texts)))

    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    part = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    part[i] = min(part[i], part[j])
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fps[i]:016x}", part[i])
    assert simhash.one_of_each_group(docs(spark, texts), 4, 4).count() == len(set(part))
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits, hot, block", [(4, 2048, 8192), (4, 3, 0), (4, 3, 8192), (6, 3, 5), (6, 2048, 8192), (0, 2048, 8192)])
def test_fingerprint_links_lose_none(spark, bits, hot, block):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 5)), replace=False)) for c in centres for _ in range(25)})
    part = list(range(len(fps)))
    for _ in range(12):
        part = [min(part[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits) for i in range(len(fps))]
    links = simhash.fingerprint_links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long"), bits, hot, block)
    got = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == part


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + rng.standard_normal(16) * (0.05 if i % 3 else 0.6)).tolist(), i % 6 // 3) for i in range(60)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] + [1.0] * 15, 0), (103, rows[0][1], None), (104, [1.0, 2.0], 0), (105, [None] * 16, 0), (106, [], 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit(1))
    got = {r.vec_id: r for r in embedding_links.embedding_links(df, block=block).collect()}
    fine = {i: (np.array(v, np.float32).astype(float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, (w, m) in fine.items() if j != i and m == l and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, (v, l) in fine.items()}
    part = {i: i for i in got}
    for _ in range(60):
        part = {i: min([part[i], *(part[j] for j in near.get(i, ()))]) for i in part}
    for i in got:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, ())), part[i], part[i] == i)
    assert any(near.values())


def test_filter_of_ids_loses_none(spark, monkeypatch):
    from tieout.llm import common

    ids = spark.createDataFrame([(5,), (None,), (-7,), (123456789,)], "doc long")
    rows = spark.createDataFrame([(i,) for i in (*range(200), -7, 123456789, None)], "id long")
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = {r.id: r._may for r in common.may_have(rows, "id", ids, "_may").collect()}
        assert got[5] and got[-7] and got[123456789] and sum(got.values()) < 20


def test_equal_vectors_are_one_point(spark):
    n = 20_000
    same = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(i)) for i in range(8)]).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    more = spark.createDataFrame([(n, [float(i) for i in range(7)] + [7.1], 1), (n + 1, [-1.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    got = {(r.n_links, r.component_id): r.n for r in embedding_links.embedding_links(same.unionByName(more)).groupBy("n_links", "component_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(n, 0): n + 1, (0, n + 1): 1}
    assert embedding_links.embedding_links(more.limit(0)).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    from tieout.llm import components

    monkeypatch.setattr(components, "LEAST_HUB", 4)
    monkeypatch.setattr(components, "HUBS", 1 << 40)
    random.seed(9)
    edges = [(500, i) for i in range(1, 60)] + [(random.randint(1000, 1100), random.randint(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    part = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(120):
        for x, y in edges:
            if x in part and y in part:
                part[x] = part[y] = min(part[x], part[y])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == part


def test_lattice_scores(spark):
    texts = ["the cat the dog", "The \x0b rare日word", None, "", "cat unseen", "the cat the dog"] * 3
    got = by_id(lattice_lm.lattice_scores(docs(spark, texts), PIECES, held_out(F.col("doc_id"), 7, 2), frequent=4))
    words = {i: (t or "").encode().lower().split() + [b" end"] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i in words if not out[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert lattice_lm.lattice_scores(docs(spark, []), PIECES, F.lit(False)).count() == 0


def brute_log10(word, logs):
    """The log of the sum over all segmentations, each spelt out."""

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(logs[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in logs)
        return out if s[0] in logs else out + math.exp(sum(logs[f"<0x{b:02X}>"] for b in s[0].encode())) * total(s[1:])

    return math.log10(total("▁" + word))


def test_lattice_sums_over_all_segmentations():
    logs = lattice_lm.pieces(PIECES).logs
    assert sum(map(math.exp, logs.values())) == pytest.approx(1)
    for word in ("the", "ting", "abcde", "rare日x𝒳"):
        assert lattice_lm.log_probability(word, logs, 16) / math.log(10) == pytest.approx(brute_log10(word, logs))
    long = lattice_lm.log_probability("ab" * 5000, logs, 16)  # no underflow
    assert math.isfinite(long) and long < -5000


def test_scores_of_both_kinds_of_file():
    assert lattice_lm.log_weights([-1e9, 0.0, -1.0, -1e9]) == [-math.log(202), -math.log(200), -math.log(201), -math.log(202)]
    assert lattice_lm.log_weights([-3.5, -2.25]) == [-3.5, -2.25]


@pytest.mark.parametrize("frequent", [4, 1 << 19])
def test_lattice_scores_of_whole_documents(spark, frequent):
    texts = ["the cat", "The dog\tthe cat", None, "", "日x", "the cat", "  "] * 2
    got = by_id(lattice_lm.lattice_scores(docs(spark, texts), PIECES, held_out(F.col("doc_id"), 7, 2), frequent=frequent))
    logs = lattice_lm.pieces(PIECES).logs
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        assert got[i].score == pytest.approx(sum(brute_log10(w, logs) for w in words) + logs[lattice_lm.END] / math.log(10))


@pytest.mark.parametrize("frequent", [4, 1 << 19])
def test_counted_lattice_scores(spark, frequent):
    texts = [" ".join(f"w{i * j % 7}ord" for j in range(40)) for i in range(30)] + [None, "日x unmet"]
    got = by_id(lattice_lm.lattice_scores(docs(spark, texts), PIECES, held_out(F.col("doc_id"), 7, 2), frequent=frequent, counted=True))
    logs = lattice_lm.pieces(PIECES).logs
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    c = Counter(w for i in words if not got[i].held_out for w in [*words[i], None])
    n, v = sum(c.values()), len(c)
    spelt = {w: logs[lattice_lm.END] / math.log(10) if w is None else brute_log10(w, logs) for i in words for w in [*words[i], None]}
    for i in words:
        assert got[i].score == pytest.approx(sum(math.log10((c[w] + v * 10 ** spelt[w]) / (n + v)) for w in [*words[i], None]))
    held = [r for r in got.values() if r.held_out and r.n_known == r.n_tokens]
    assert len(held) > 1 and all(r.score > r.base_score - 0.2 * r.n_tokens for r in held)
    assert sum(10 ** lattice_lm.log10_mixed(c[w], spelt[w], n, v) for w in spelt) < 1
    none = by_id(lattice_lm.lattice_scores(docs(spark, ["a" * 3000, ""]), PIECES, F.lit(True), counted=True))
    assert all(math.isfinite(r.score) for r in none.values()) and lattice_lm.log10_mixed(0, -5000.0, 10, 5) == pytest.approx(-5000 + math.log10(5 / 15)) and math.isfinite(lattice_lm.log10_mixed(2, -5000.0, 10, 5))


def test_lattice_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "the cat"), (1, "a" * 100_000), (1, "a" * 100_000), (2, "x " * 20_000)], "doc_id long, text string")
    rows = lattice_lm.lattice_scores(df, PIECES, F.lit(None)).collect()
    assert len(rows) == 4 and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)


def brute_removed(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("most, frequent", [(1 << 15, 1 << 12), (4, 2), (1, 1 << 12)])
def test_suffix_dedup(spark, monkeypatch, most, frequent):
    random.seed(4)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "OFTEN", min(frequent, suffix_dedup.OFTEN))
    base = "".join(random.choice("abcdefgh ij") for _ in range(500))
    texts = [None, "", "a" * 300, "ab" * 120, "a" * 150 + "b", "é" * 60, "é" * 60 + "!"]
    for _ in range(40):
        t = list(base[random.randint(0, 150) : random.randint(300, 500)])
        for _ in range(random.randint(0, 3)):
            t[random.randrange(len(t))] = random.choice("XYZ")
        texts.append("".join(t) + "".join(random.choice("klm") for _ in range(random.randint(0, 40))))
    got = by_id(suffix_dedup.without_repeats(docs(spark, texts), 100, most=most))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_removed(texts, 100)


def test_long_texts_are_cut_into_parts_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 200)
    random.seed(8)
    x = "".join(random.choice("abcd ") for _ in range(900))
    texts = [x, "q" + x[100:700] + "r", x[::-1]]
    rows = list(suffix_dedup._found(100)(iter([__import__("pyarrow").RecordBatch.from_pydict({"id": [0, 1, 2], "text": texts})])))
    covered = Counter()
    for b in rows:
        doc, at, d1 = (b.column(c).to_numpy() for c in ("doc", "at", "d1"))
        last = np.where(at & suffix_dedup.REPEAT == suffix_dedup.REPEAT, (at >> 32) + d1, suffix_dedup._last_of_block(at))
        covered.update((d, s) for d, f, l in zip(doc.tolist(), (at >> 32).tolist(), last.tolist()) for s in range(f, l + 1))
    assert set(covered) == {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 99)}


def suffixes(texts, groups):
    sizes = np.array([len(t) for t in texts])
    return suffix_dedup.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(groups))


@pytest.mark.parametrize("weak", [False, True])
def test_merge_sort_of_suffixes(monkeypatch, weak):
    """Within groups, as bytes are sorted; also where every hash is alike."""
    if weak:
        monkeypatch.setattr(suffix_dedup.Prefixes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    random.seed(6)
    texts, groups = [], []
    for g in range(30):
        for _ in range(random.choice([1, 2, 3, 17])):
            texts.append(bytes(random.choice(b"ab") for _ in range(random.randint(0, 12))))
            groups.append(g)
    order, common = suffixes(texts, groups).checked()
    assert [(groups[i], texts[i]) for i in order] == sorted(zip(groups, texts))
    for a, b, n in zip(order, order[1:], common[1:]):
        s, t = texts[a], texts[b]
        assert s[:n] == t[:n] and (n == min(len(s), len(t)) or s[n] != t[n])


def test_hash_collisions_are_found_out(spark, monkeypatch):
    """With every polynomial hash alike all strings pick one gram at one place, and results stay right."""
    monkeypatch.setattr(suffix_dedup, "_mix", lambda h: h & np.uint64(0))
    random.seed(5)
    base = "".join(random.choice("abc ") for _ in range(260))
    texts = [base, base[40:200] + "x", "y" + base[90:], base, None, base[::-1]]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": list(range(6)), "text": texts})
    rows = [r for b in suffix_dedup._found(100)(iter([batch])) for r in zip(*(b.column(i).to_pylist() for i in range(5)))]
    settled = [r for b in suffix_dedup._settled(iter([suffix_dedup._rows(*zip(*sorted(rows)))]), np.zeros(0, np.int64)) for r in zip(*(b.column(i).to_pylist() for i in range(5)))]
    gone = {(doc, s) for h, d1, d2, doc, at in settled if at & suffix_dedup.REPEAT == suffix_dedup.REPEAT for s in range(at >> 32, (at >> 32) + d1 + 1)}
    blocks = sorted({(h, doc, at >> 32, (at >> 16 & 65535) + (at >> 32), at & 65535) for h, d1, d2, doc, at in settled if at & suffix_dedup.REPEAT != suffix_dedup.REPEAT}, key=lambda r: (r[0], r[1], r[2] + r[4]))
    h, doc, first, last, gram = (np.array(c) for c in zip(*blocks))
    data = [(texts[d] or "").encode()[f : l + 100] for d, f, l in zip(doc, first, last)]
    for d, a, b in zip(*suffix_dedup.shared_strings(h, doc, first, gram, data, 100)):
        gone |= {(int(d), s) for s in range(a, b + 1)}
    seen, want = {}, set()
    for i, t in enumerate(texts):
        for s in range(len(t or "") - 99):
            if seen.setdefault(t[s : s + 100], (i, s)) != (i, s):
                want.add((i, s))
    assert gone == want and len(want) > 100


def test_quality_rules(spark):
    texts = [None, "", "few words", "good clean words in a row " * 6, " ".join(f"w{i}" for i in range(40)), "# * $ x | y\n# * $ x | y\n\n  \n" + " ".join(f"v{i}" for i in range(30)), "spam$$$ eggs&&& " * 3 + " ".join(f"z{i}%%%" for i in range(30))]
    got = by_id(quality_rules.quality_rules(docs(spark, texts), spark.createDataFrame([(4,), (5,)], "doc_id long")))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in enumerate(texts):
        w = word.findall(t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(grams)
        repeat = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)})
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, failed)
        assert not (failed and got[i].kept)
    counts, target = Counter(), Counter()
    mask = quality_rules.BUCKETS - 1

    def buckets(w):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [x - (1 << 64) if x >> 63 else x for x in h]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42))
        return [x & mask for x in h] + [pair(a, b) & mask for a, b in zip(signed, signed[1:])]

    features = [buckets(word.findall(t or "")) for t in texts]
    for i, f in enumerate(features):
        counts.update(f)
        if i in (4, 5):
            target.update(f)
    shift = math.log((sum(counts.values()) + mask + 1) / (sum(target.values()) + mask + 1))
    for i, f in enumerate(features):
        weight = sum(round(1e6 * (math.log((target[b] + 1) / (counts[b] + 1)) + shift)) for b in f)
        assert got[i].llr_micro == (math.floor(weight / len(f)) if f else 0)
    assert got[4].llr_micro > got[6].llr_micro
