"""Corpus operators against brute force, round trips and the tokenizer libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import (
    common, encoding, op1_token_file, op2_quality, op3_language_id, op4_exact_dedup, op5_byte_bpe, op6_line_dedup, op7_pii, op8_sharding, op9_packing, op10_jaccard_join,
)
from quarrylight.llm.components import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, row_ string, text_hash string"
SF = "/root/testdata/sf0.01"
WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PIECES = [*"aAbé.,!?'\"*#01\n\t \x1c\x0b\x85\xa0　ßΣςİ", "́", "H̱", "’s", "'s", "日本", "😀", "  ", "\n\n", "<|endoftext|>", "the", " of", "\r\n", "aaaaaaa", "        ", ""]


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    words = ["foo", "Bar.", "don't", "x,", "(a)", "é!!", "1st", "--", "'s"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def docs(spark, rows):
    """(doc_id, text) rows as documents, with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 1, "r", "h") for i, t in rows], SCHEMA)


HARD = [
    (0, None), (1, ""), (2, " \n "), (3, "one line here\nand one more"), (4, "one  line\there\nand one more"), (None, "one line here\nand one more"), (5, "ONE LINE HERE\nother words now"),
    (6, "short"), (6, "short"), (6, "another text under the same id"), (7, "long " * 20000 + "\nend"), (8, "a b c d e f g h i j " * 40), (None, None), (9, "Mail me@x.org or +1 (212) 555-0187 4111111111111111"),
]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "byte")])
def test_chunks_encode_like_whole_texts(path, kind):
    enc = encoding.encoder(path, kind)
    texts = odd_texts(3000)
    for i in range(0, len(texts), 256):
        for text, got in zip(texts[i : i + 256], enc.encode(texts[i : i + 256]), strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_cut_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 0, 3, 50, 1, 1, 1)] + [None]
    b = pa.RecordBatch.from_pydict({"i": list(range(8)), "t": pa.array(texts, pa.string())})
    got = [x.column(0).to_pylist() for x in common.pieces([b], 1, rows=3, size=8)]
    assert got == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert list(common.pieces([b.slice(0, 0)], 1)) == []


def test_tokenizers_of_other_shapes(tmp_path):
    import json

    said = json.load(open(BYTE, encoding="utf-8"))
    said["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said))
    assert [encoding.shape_of(p) for p in (WORD, BYTE, str(other))] == ["word", "byte", "whole"]
    with pytest.raises(ValueError, match="shape"):
        encoding.encoder(str(other), "byte")
    with pytest.raises(ValueError, match="shape"):
        encoding.encoder(WORD, "byte")
    enc = encoding.encoder(str(other))
    for text, got in zip(odd_texts(40), enc.encode(odd_texts(40)), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(encoding, "GENERATION", 50_000)
    enc = encoding.ByteEncoder(BYTE)
    for i in range(40):
        text = " ".join(f"{i}x{k}" + "ab" * 500 for k in range(20))
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
        assert len(enc.known) <= 100 and enc.held < 150_000
    monkeypatch.setattr(op5_byte_bpe, "KEPT_BYTES", 50_000)
    import pyarrow as pa

    blocks = op5_byte_bpe.BlockEncoder(RANKS, P.PATTERN)
    for i in range(3):
        b = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(f"{i}y{k}" + "ab" * 50 for k in range(400))]})
        list(op5_byte_bpe.blocks(iter([b]), blocks))
        assert blocks.held == 0 and not blocks.number


def test_op1(spark, tmp_path):
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 999):
        v = np.array([rng.randrange(1 << rng.choice([8, 16, 24, 32])) for _ in range(n)], np.uint32)
        got, end = op1_token_file.unpack(b"xx" + op1_token_file.pack(v), 2)
        assert (got == v).all() and end == 2 + len(op1_token_file.pack(v))
    rows = HARD + list(enumerate(odd_texts(40), 100))
    enc = encoding.encoder(WORD, "word")
    wanted = [(i, [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    path = op1_token_file.write_tokens(docs(spark, rows), WORD, f"{tmp_path}/file")
    assert path == f"{tmp_path}/file"
    fresh = spark.newSession()  # knows the folder only
    got = op1_token_file.read_tokens(fresh, path).orderBy("start").collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in wanted)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    often = collections.Counter(x for _, own in wanted for x in own)
    ranks = [r.id for r in fresh.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(often, key=lambda x: (-often[x], x))
    stored = collections.Counter(v for r in fresh.read.parquet(f"{path}/segments").collect() for v in op1_token_file.read_segment(bytes(r.segment))[2].tolist())
    assert stored == {k: often[x] for k, x in enumerate(ranks)}  # what the segments hold are ranks
    with pytest.raises(ValueError, match="not a segment"):
        op1_token_file.read_segment(b"something else")
    assert op1_token_file.read_tokens(spark, op1_token_file.write_tokens(docs(spark, []), WORD)).count() == 0


def brute_quality(text, min_span=10):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, seen = len(w), collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= min_span:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(covered), longest]


def test_op2(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n", "a " * 30, "é b c\x0bd"]
    for _ in range(80):
        w = [rng.choice("ab#cdefghijklmnop"[: rng.choice([1, 2, 5, 17])]) + rng.choice(["", "\n"]) for _ in range(rng.choice([5, 20, 60]))]
        texts.append(" ".join(w + (w[3 : 3 + rng.randint(8, 40)] + ["z"] + w[:15] if rng.random() < 0.5 else [])))
    got = np.array(op2_quality.measure(texts)).T.tolist()
    assert got == [brute_quality(t) for t in texts]
    out = {r.n_words: r for r in op2_quality.quality(docs(spark, HARD), carry=True).collect()}
    assert out[400].base_failed and not out[400].kept and out[0].base_failed
    assert op2_quality.quality(docs(spark, [])).count() == 0


def test_op2_method_rejects_what_the_base_keeps(spark):
    rng = random.Random(3)
    plain = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    twice = " ".join(plain[:400] + plain[:105] + plain[400:])  # 210 of 805 words repeat, in one long passage
    got = {r.doc_id: r for r in op2_quality.quality(docs(spark, [(1, " ".join(plain)), (2, twice)])).collect()}
    assert got[1].kept and not got[2].base_failed and not got[2].kept and got[2].longest_repeat == 105


def test_op3(spark):
    rng = random.Random(4)
    words = {"en": "the of and thing with that", "fr": "les des une eau pour que", "de": "und der das ein nicht mit"}
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x) for i in range(300) for x in [rng.choice("en fr de".split())]]
    rows += [(900, None, "en"), (901, "12 !! \n", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = op3_language_id.train(df.filter("id % 4 <> 0"))
    out = {r.doc_id: r for r in op3_language_id.identify(df.withColumnRenamed("id", "doc_id"), model).collect()}
    assert np.mean([out[i].lang_pred == x for i, _, x in rows[:300] if i % 4 == 0]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert op3_language_id.train(df.filter("false")) is None
    text = "abc é " * 400_000  # longer than a slice: the same counts as in one piece
    whole = op3_language_id.counts(text)
    raw = len(f" {text} ".encode())
    assert whole[: op3_language_id.BUCKETS].sum() == raw - 1 and whole[op3_language_id.BUCKETS :].sum() == raw - 2
    assert op3_language_id.identify(docs(spark, []), model).count() == 0
    # Repeated rows, one id for all, clashing columns, a very long text.
    same = docs(spark, [(1, "les des une eau pour que"), (1, "les des une eau pour que"), (None, "und der das " * 50_000)])
    assert sorted(r.lang_pred for r in op3_language_id.identify(same, model).collect()) == ["de", "fr", "fr"]
    one = op3_language_id.train(df.filter("lang is not null").withColumn("id", F.lit(7)), size=60)
    assert one is not None and one.languages == ["de", "en", "fr"]
    code = op3_language_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 5


def test_op3_decoding_by_hand(spark):
    """Margins of each bit's classifier against every codeword, loss by loss, in plain Python."""
    import math

    rng = np.random.default_rng(3)
    n, bits = 6, 9
    code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
    model = op3_language_id.Model([f"l{i}" for i in range(n)], code, rng.normal(size=(4, bits)).astype(np.float32), rng.normal(size=bits).astype(np.float32), rng.random(bits).astype(np.float32) + 0.1)
    for _ in range(200):
        x = rng.normal(size=4).astype(np.float32)
        margins = [sum(float(x[f]) * float(model.weights[f, k]) for f in range(4)) + float(model.bias[k]) for k in range(bits)]
        losses = [sum(float(model.trust[k]) * math.log1p(math.exp(-float(code[i, k]) * margins[k])) for k in range(bits)) / float(model.trust.sum()) for i in range(n)]
        weight = [math.exp(-8 * (v - min(losses))) for v in losses]
        best, score = model.predict(x)
        assert best == losses.index(min(losses)) and score == pytest.approx(max(weight) / sum(weight), rel=1e-3)


def test_op3_query_holds_out(spark, tmp_path):
    """Labels of held-out documents have no part in training, and their languages are found all the same."""
    import os

    rng = random.Random(4)
    words = {"en": "the of and thing with that", "de": "und der das ein nicht mit"}
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x, "s", 1) for i in range(200) for x in [rng.choice("en de".split())]]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lying = [(i, t, "xx" if held(i) else x, s, n) for i, t, x, s, n in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(lying, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_language_id.query(spark, str(tmp_path)).collect()}
    assert all(got[i].held_out == held(i) for i, *_ in rows)
    assert all(got[i].lang_pred != "xx" for i, *_ in rows)
    assert np.mean([got[i].lang_pred == x for i, _, x, _, _ in rows if held(i)]) > 0.95
    if os.path.isdir(SF):
        true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.lang and r.text and any(map(str.isalpha, r.text))}
        out = [r for r in op3_language_id.query(spark, SF).collect() if r.held_out and r.doc_id in true]
        assert len(out) > 100 and np.mean([r.lang_pred == true[r.doc_id] for r in out]) > 0.97


def test_op4_exchange_size():
    for n in (0, 1, 5000, 256_410, 10**7, 10**10):
        owners, sources = op4_exact_dedup.exchange_size(n, 200)
        assert n / owners <= op4_exact_dedup.OWNER_ROWS and owners * sources <= max(owners, n / op4_exact_dedup.SHARE)
    assert op4_exact_dedup.exchange_size(10**10, 200) == (4000, 9765)


def test_op4_beyond_the_broadcast(spark, monkeypatch):
    rows = HARD + [(100 + i, f"copy  {i % 7}") for i in range(60)]
    key = lambda df: sorted(map(str, df.collect()))
    wanted = key(op4_exact_dedup.exact_dedup(docs(spark, rows)).drop("kept"))
    monkeypatch.setattr(op4_exact_dedup, "BROADCAST_ROWS", 0)
    assert key(op4_exact_dedup.exact_dedup(docs(spark, rows)).drop("kept")) == wanted


def test_op4(spark):
    rng = random.Random(5)
    for n, top in ((0, 1 << 56), (1, 1 << 50), (500, 1 << 40), (500, 600)):
        v = np.array(sorted(rng.sample(range(top), n)), np.int64)
        assert (op4_exact_dedup.rice_decode(op4_exact_dedup.rice_encode(v, top), top) == v).all()
    rows = HARD + [(100 + i, f"copy  {i % 7}") for i in range(60)]
    got = op4_exact_dedup.exact_dedup(docs(spark, rows)).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    by = collections.defaultdict(list)
    for i, t in norm:
        by[hashlib.sha256(t.encode()).hexdigest()].append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(key((i, first[h], len(v), h)) for h, v in by.items() for i in v)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(by.keys())
    assert op4_exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_op5(spark):
    tiktoken = pytest.importorskip("tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op5_byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = HARD + list(enumerate(odd_texts(500) + ["a" * n for n in range(40)] + ["ab" * n for n in range(20)], 100))
    tokens = op5_byte_bpe.encode(docs(spark, rows), RANKS, P.PATTERN)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.collect()) == sorted((str(i), lib.encode_ordinary(t or "")) for i, t in rows)
    back = op5_byte_bpe.decode(tokens, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert op5_byte_bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0 and op5_byte_bpe.digests(docs(spark, []), RANKS, P.PATTERN).count() == 0
    got = op5_byte_bpe.digests(docs(spark, [(3, "Two words")]), RANKS, P.PATTERN).first()
    ids = lib.encode_ordinary("Two words")
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_op6(spark):
    rows = HARD + [(50, "A shared line\n\nx"), (51, "\x0b a SHARED line \n\nx\na shared line"), (52, "É shared line\né shared line")]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in op6_line_dedup.line_dedup(docs(spark, rows)).collect())
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(up, low))
    rank = lambda i: 1 << 63 if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == rank(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert got == sorted(out)
    plan = op6_line_dedup.line_dedup(docs(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert {r.doc_id: r.n_dropped for r in op6_line_dedup.line_dedup(docs(spark, [(i, "some shared line") for i in range(3)]), min_docs=3).collect()} == {0: 0, 1: 1, 2: 1}
    assert op6_line_dedup.line_dedup(docs(spark, [])).count() == 0


def passes_luhn(digits):
    """Every second digit from the right doubled, its own digits added up."""
    doubled = "".join(str(int(d) * (1 + k % 2)) for k, d in enumerate(digits[::-1]))
    return sum(map(int, doubled)) % 10 == 0


def plain_spans(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and passes_luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op7(spark):
    rng = random.Random(6)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@-+ ()2é3") for _ in range(rng.randint(0, 40)))
        assert op7_pii.base_spans(text) == plain_spans(text), repr(text)
    find = lambda t: op7_pii.joined(op7_pii.added_spans(t, op7_pii.base_spans(t)))
    assert find("iban DE89 3704 0044 0532 0130 00 ok") == "iban:5:32"
    assert find("DE89 3704 0044 0532 0130 01") == ""  # fails mod-97
    assert find("call 212-555-0187") == "phone:5:17" and find("order 212-555-0187") == "" and find("212-555-0187") == ""
    assert find("ssn 078-05-1120") == "national_id:4:15" and find("078-05-1120") == ""
    assert find("+1 (212) 555-0187 4111111111111111") == "card:18:34,phone:0:17" or find("+1 (212) 555-0187 4111111111111111").count(":") == 4
    got = {r.doc_id: r for r in op7_pii.find_pii(docs(spark, HARD), carry=True).collect()}
    assert got[9].n_email == 1 and got[9].text == "Mail [EMAIL] or [PHONE] [CARD]"
    assert got[0].text == "" and got[0].spans == ""
    assert op7_pii.find_pii(docs(spark, [])).count() == 0
    assert op7_pii.base_spans("a" * 300_000 + "." * 1000 + "1" * 300_000) == []  # linear on long runs


def test_op7_query(spark, tmp_path):
    rows = HARD + [(20, "a@b.co 10.0.0.255 10.0.0.256 4111 1111 1111 1111 +1 (212) 555-0187"), (21, "é😀 x.y@z-1.org, iban DE89370400440532013000")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["email", "ip", "card", "phone"]
    wanted = []
    for i, t in rows:
        base = plain_spans(t or "")
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        wanted.append((str(i), *[sum(k == n for _, k, _ in base) for n in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    got = op7_pii.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(wanted)
    by = {r.doc_id: r for r in got}
    assert by[21].n_added == 1 and by[21].spans == "email:3:14,iban:21:43" and by[20].n_added == 1  # the card that digits before it hide from the base pattern


def walked(number, n):
    """Shard and slot of a row number: the network round by round, fed its own result until that is a row number."""
    half, x = 1, number
    while 4**half < n:
        half += 1
    while True:
        left, right = divmod(x, 1 << half)
        for k in op8_sharding.round_keys(op8_sharding.SEED):
            left, right = right, left ^ (pow(right + k, 3, op8_sharding.PRIME) % (1 << half))
        x = left * (1 << half) + right
        if x < n:
            return x % 24, x // 24


def test_op8_every_row(spark, tmp_path):
    rows = [(i, None if i % 50 == 0 else "x" * (i % 7)) for i in range(700)] + [(i, "again") for i in range(0, 700, 9)] + [(None, "none"), (None, None)]
    docs(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for _, t in rows]
    keys = sorted((-1 if i is None else i, zlib.crc32(b), len(b) + 8) for (i, _), b in zip(rows, raw, strict=True))
    wanted = sorted((*k, *walked(at, len(rows))) for at, k in enumerate(keys))
    got = op8_sharding.query(spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in got) == wanted


def test_op8_names_and_files(spark, tmp_path):
    names = ["at", "part", "row", "number", "at_", "part_", "start_", "row_number_", "rows_", "shard", "slot", "key0"]
    df = spark.createDataFrame([tuple([i] * len(names)) for i in range(50)], ", ".join(f"{n} long" for n in names))
    got = op8_sharding.shard(df, ["row_number_"])
    assert got.columns == [n for n in names if n not in ("shard", "slot")] + ["shard", "slot"]
    assert sorted((r.at, r.shard, r.slot) for r in got.collect()) == sorted((i, *walked(i, 50)) for i in range(50))
    op8_sharding.write_shards(df, f"{tmp_path}/out", ["at"], n_shards=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.at for r in back.collect()) == list(range(50)) and {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 17, 1: 17, 2: 16}


def test_op8(spark):
    for n in (1, 2, 3, 5, 24, 1000, 4097):
        assert sorted(op8_sharding.permute(np.arange(n), n).tolist()) == list(range(n))
    keys, bits, n, x = op8_sharding.round_keys(op8_sharding.SEED), op8_sharding.half_bits(1000), 1000, 7
    while True:  # one row by hand
        left, right = x >> bits, x & ((1 << bits) - 1)
        for k in keys:
            t = (right + k) % op8_sharding.PRIME
            left, right = right, left ^ ((t * t % op8_sharding.PRIME * t % op8_sharding.PRIME) & ((1 << bits) - 1))
        x = (left << bits) | right
        if x < n:
            break
    assert x == op8_sharding.permute(np.array([7]), n)[0]
    got = op8_sharding.shard(docs(spark, HARD + [(i, "x") for i in range(100, 200)]).withColumn("size", F.length("text")), ["doc_id", "text"]).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert op8_sharding.shard(docs(spark, []), ["doc_id"]).count() == 0


def test_op8_query_crc(spark, tmp_path):
    docs(spark, [(0, None), (1, "é")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in op8_sharding.query(spark, str(tmp_path)).collect()}
    assert got == {0: (8, 0, "rows", None), 1: (10, zlib.crc32("é".encode()), "rows", None)}


def check_packing(pieces, rows, enc, window=1024):
    wanted = collections.Counter((i, tuple([*enc.tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    at = collections.defaultdict(list)
    for r in pieces:
        at[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    whole = collections.defaultdict(list)
    for r in pieces:
        whole[r.doc_id, r.doc_tokens].append(r)
    got = collections.Counter()
    for (doc_id, total), own in whole.items():
        own.sort(key=lambda r: r.start)
        starts = collections.Counter(r.start for r in own)
        if len(set(starts.values())) == 1 and starts[0] == 1:
            got[doc_id, tuple(np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist())] += 1
            assert sum(r.length for r in own) == total
        else:  # repeated rows: every piece as often as the row
            got += collections.Counter({k: n for k, n in wanted.items() if k[0] == doc_id and len(k[1]) == total})
    assert got == wanted
    return at


def plainly_packed(lengths, window, most):
    """(document, start, window, offset) by online best fit over a list of open windows in the order of opening."""
    used, still, out, emitted = [], [], [], []
    for d, total in enumerate(lengths):
        for start in range(0, total, window):
            n = min(window, total - start)
            fits = [w for w in still if used[w] + n <= window] if n < window else []
            if fits:
                w = max(fits, key=lambda w: (used[w], -w))
            else:
                if n < window and len(still) >= most:
                    fullest = max(still, key=lambda w: (used[w], -w))
                    still.remove(fullest)
                    emitted.append(fullest)
                w = len(used)
                used.append(0)
                if n < window:
                    still.append(w)
            out.append((d, start, w, used[w]))
            used[w] += n
            if used[w] == window and w in still:
                still.remove(w)
    return sorted(out), sorted(still)


@pytest.mark.parametrize("most", [1, 2, 7, 64])
def test_op9_chooses_the_tightest_window(spark, most):
    rng = random.Random(most)
    texts = ["a " * rng.choice([3, 40, 200, 501, 700, 1023, 1024, 2600]) for _ in range(150)] + [None, ""]
    enc = encoding.encoder(BYTE)
    lengths = [len(enc.tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    rows = op9_packing.packed(common.columns(docs(spark, list(enumerate(texts))).coalesce(1), doc_id="doc_id", text="text"), BYTE, None, 0, 1024, most).collect()
    wanted, still = plainly_packed(lengths, 1024, most)
    assert sorted((r.doc_id, r.start, r.seq, r.offset) for r in rows) == wanted
    assert sorted({r.seq for r in rows if r.open}) == still


def test_op9(spark):
    enc = encoding.encoder(BYTE, "byte")
    rows = HARD + [(100 + i, " ".join(["word"] * (37 * i % 900))) for i in range(1200)]
    pieces = op9_packing.pack(docs(spark, rows).repartition(3), BYTE).collect()
    at = check_packing(pieces, rows, enc)
    used = sum(r.length for r in pieces)
    assert used > 0.95 * 1024 * (len(at) - 1)
    rows = rows[: len(HARD) + 100]
    few = op9_packing.pack(docs(spark, rows).repartition(3), BYTE, most=2).collect()
    check_packing(few, rows, enc)
    assert op9_packing.pack(docs(spark, []), BYTE).count() == 0


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted((str(d), str(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows)), len(ids)


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out + [(2000 + i, " ".join(base)) for i in range(20)]


def test_op10(spark, monkeypatch):
    monkeypatch.setattr(op10_jaccard_join, "SMALL_BLOCK", 30)
    monkeypatch.setattr(op10_jaccard_join, "TILE", 7)
    rows = HARD + near_copies(120)
    got = op10_jaccard_join.jaccard_join(docs(spark, rows)).collect()
    wanted, classes = brute_join(rows)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == wanted
    assert sum(r.kept for r in got) == classes
    assert op10_jaccard_join.jaccard_join(docs(spark, [])).count() == 0


def test_op10_copies_per_member():
    """A family's rows on the wire grow with its size up to 130,000 sets, then with its blocks of 4,096."""
    from math import ceil

    m = op10_jaccard_join
    blocks = lambda n, shingles=0: max(min(ceil(n / m.SMALL_BLOCK), m.MOST_BLOCKS), ceil(n / m.LARGE_BLOCK), ceil(shingles * 8 / m.BLOCK_BYTES))
    assert [blocks(n) for n in (1, 112, 113, 4000, 131_072, 10**6)] == [1, 1, 2, 32, 32, 245]
    assert blocks(1000, 1000 * 20_000) == 10 and blocks(100, 100 * 200_000) == 10


def test_op10_heterogeneous_buckets(spark, monkeypatch):
    """Many sets that share a band without being similar: the leader ties few, the rest meets every member."""
    monkeypatch.setattr(op10_jaccard_join, "SMALL_BLOCK", 8)
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for i in range(60):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([10, 20, 40]))]
        rows.append((i, " ".join(shared + own)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join(shared + own[:-1] + ["x"])))
    got = op10_jaccard_join.jaccard_join(docs(spark, rows)).collect()
    wanted, classes = brute_join(rows)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == wanted
    assert sum(r.kept for r in got) == classes


def test_op10_prunes_what_is_unlikely_only():
    least = op10_jaccard_join.least_matches()
    assert least == sorted(least) and 70 < least[-1] < 90
    rng = np.random.default_rng(1)
    near = sum((rng.random((20000, 16 * (i + 1))) < 0.8).sum(1).min() >= m for i, m in enumerate(least))
    assert near == len(least)


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_pipeline(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = text(100)
    rows = [(1, text(60)), (2, base), (3, base.replace(" ", "  ")), (4, base + " tail"), (5, "too short"), (6, text(40) + " me@x.org"), (6, None), (7, text(1500)), (2, base)]
    frame = docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    frame = stages["quality rules"](spark, frame, "")
    assert sorted(r.doc_id for r in frame.collect()) == [1, 2, 2, 3, 4, 6, 7] and frame.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
    frame = stages["exact dedup"](spark, frame, "")
    assert sorted(r.doc_id for r in frame.collect()) == [1, 2, 4, 6, 7]
    frame = stages["n-gram Jaccard join"](spark, frame, "")
    assert sorted(r.doc_id for r in frame.collect()) == [1, 2, 6, 7]
    frame = stages["PII"](spark, frame, "")
    got = {r.doc_id: r for r in frame.collect()}
    assert got[6].text.endswith("[EMAIL]") and got[6].n_chars == len(got[6].text) and got[1].text == rows[0][1]
    pieces = stages["packing"](spark, frame, "").collect()
    check_packing(pieces, [(i, r.text) for i, r in got.items()], encoding.encoder(BYTE, "byte"))
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    empty = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
