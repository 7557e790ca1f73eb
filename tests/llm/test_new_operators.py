"""Operators 11 to 13 against the public libraries and brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import lodeframe.llm.queries as Q
from lodeframe.llm import alignment, prefix_bpe, splitting, whitening

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", " \n\t ", "a", "Hello World, it's 12 <|endoftext|> o'clock ﬁ é́ 日本語 \U0001f600\x00\x85 K", "don't 'LL 've 's 'sx", "  lead and trail  ",
    "mark ▁ inside", "<s> </s> <unk> <0x0A> \n\n\n===========================", "한국어 текст ünïcödé ١٢٣ ⅷ௵", "a" * 300, "日本" * 200, " " * 700 + "x", "x" + "\n" * 300,
    "same text", "same text", " ".join(f"w{i}ord" for i in range(3000)), "néw\U00010940꟎⃁ letters ᲊ", "\x1c\x1d\x1e\x1f\x85 \xa0 　 odd blanks",
]
TEXT = [t or "" for t in TEXTS]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumns({c: F.lit("mine") for c in ("row", "last", "pairs", "x", "n", "groups")}).cache()


@pytest.fixture(scope="module")
def tiktoken_library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe(docs, tiktoken_library):
    got = prefix_bpe.byte_bpe_decode(prefix_bpe.byte_bpe_encode(docs, RANKS, PATTERN), RANKS)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else 3, r["ids"], bytes(r["decoded"])) for r in got.collect())
    assert found == [(i, tiktoken_library.encode_ordinary(t), t.encode()) for i, t in enumerate(TEXT)]
    assert prefix_bpe.byte_bpe_encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_op11_on_documents(spark, tiktoken_library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.QUERIES["op11_byte_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tiktoken_library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), r["text"] or "")))


def test_split_follows_the_library_on_characters_of_newer_unicode():
    split = splitting.Splitter()
    member = splitting.class_by(splitting.by_tiktoken)
    for low in (0x500, 0x1C80, 0x2080, 0xA7C0, 0x10900, 0x11DE0, 0x31350, 0x3FC00):
        for c in map(chr, range(low, low + 0x80)):
            words = split(f"a{c} {c}1{c}")
            kind = member(c)
            assert words[0] == ("a" + c if kind == "L" else "a"), hex(ord(c))
            assert (f" {c}1{c}" in words) == (kind == "N"), hex(ord(c))


def test_word_bpe_follows_the_library_on_characters_of_newer_unicode():
    from tokenizers import Tokenizer

    from lodeframe.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    for low in (0x500, 0x1C80, 0x2080, 0xA7C0, 0x10900, 0x11DE0, 0x31350, 0x3FC00):
        for c in map(chr, range(low, low + 0x80)):
            text = f"a{c}b {c}{c} 1{c}"
            assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_appends_and_edits_are_exact(tiktoken_library):
    encoder, draw = prefix_bpe.load(RANKS, PATTERN), np.random.default_rng(4)
    alphabet = ["a", "b", " ", "\n", "'", "s", "l", "1", "é", "日", "the", "==", " ing", "\U0001f600", "aaaa", "  ", "\t", "ⅷ"]
    some = lambda most: "".join(draw.choice(alphabet, draw.integers(0, most)))
    for _ in range(300):
        text = some(60)
        row = prefix_bpe.Stored.of(encoder, text)
        for _ in range(4):
            assert row.tokens() == tiktoken_library.encode_ordinary(text)
            a = int(draw.integers(0, len(text) + 1))
            b, new = min(len(text), a + int(draw.integers(0, 12))), some(8)
            row.edit(a, b, new)
            text = text[:a] + new + text[b:]
            fresh = prefix_bpe.Stored.of(encoder, text)
            assert (row.text, row.cuts, row.last) == (fresh.text, fresh.cuts, fresh.last)
    long = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    row = prefix_bpe.Stored.of(encoder, long)
    assert row.edit(50_000, 50_003, "xyz") < 2 * encoder.prefixes.longest + 3 and row.edit(100_000, 100_000, "tail") == 4
    assert row.tokens() == tiktoken_library.encode_ordinary(row.text)


def test_stored_prefixes_as_tables(docs, tiktoken_library):
    stored = prefix_bpe.byte_bpe_prefixes(docs, RANKS, PATTERN)
    edits = stored.withColumns({"start": F.when(F.col("doc_id") % 2 == 0, 3), "stop": F.lit(5), "new": F.lit("né w")})
    got = prefix_bpe.byte_bpe_edit(edits, RANKS, PATTERN).where("doc_id is not null").collect()
    assert len(got) == len(TEXTS) - 1
    for r in got:
        t = TEXT[r["doc_id"]]
        a = min(3, len(t)) if r["doc_id"] % 2 == 0 else len(t)
        assert r["text"] == t[:a] + "né w" + t[max(a, min(5, len(t))) :]
        assert r["ids"] == tiktoken_library.encode_ordinary(r["text"]) and len(r["last"]) == len(r["text"].encode())
    assert prefix_bpe.byte_bpe_prefixes(docs.limit(0), RANKS, PATTERN).count() == 0


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum), by the libraries and plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from lodeframe.llm.bpe import byte_symbols

    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbol = {c: b for b, c in enumerate(byte_symbols())}
    rows, counts = [], Counter()
    for t in texts:
        a = a_library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_library.encode(t) if t else []
        bytes_a = [bytes(symbol[c] for c in a_library.id_to_token(i)) for i in a]
        pieces = [b_library.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        want = (" " + t).encode()
        groups = []
        if t and b"".join(bytes_a) == want and b"".join(bytes_b) == want:
            i = j = x = y = 0
            group = ([], [])
            while i < len(a) or j < len(b):
                if x <= y and i < len(a) and (x < y or not group[0] or j == len(b)):
                    group[0].append(a[i])
                    x += len(bytes_a[i])
                    i += 1
                else:
                    group[1].append(b[j])
                    y += len(bytes_b[j])
                    j += 1
                if x == y:
                    groups.append(group)
                    group = ([], [])
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        counts.update(links.keys())
        rows.append((groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for groups, links in rows:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_best = sum(n for k, n in links.items() if counts[k] == best[k[0]])
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), shown, n_best, sum(n * counts[k] for k, n in links.items())))
    return out


def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), PATTERN, public_tokenizers.path("piece_bpe_32k.model")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def test_alignment(docs):
    want = brute_alignment(TEXT)
    assert want[8][0] == 0 and want[5][3] > want[5][2]
    got = alignment.alignment_statistics(docs, *paths(), digest=False).collect()
    assert {r["doc_id"] if r["doc_id"] is not None else 3: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(want)) and len(got) == len(TEXTS)
    assert alignment.alignment_statistics(docs.limit(0), *paths()).count() == 0


def test_pairs_of_a_text_may_need_several_rows(docs, monkeypatch):
    aligner = alignment.Aligner(*paths())
    block = aligner.block(TEXTS)
    whole = [(t, p, n) for chunk in block.pairs() for t, p, n in zip(*chunk)]
    monkeypatch.setattr(alignment, "PAIRS", 500)
    chunks = list(block.pairs())
    parts = [(t, p, n) for chunk in chunks for t, p, n in zip(*chunk)]
    assert len(chunks) > 5 and sorted(parts) == sorted(whole) and len({x[:2] for x in parts}) == len(parts)


def test_op13_on_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, brute_alignment(list(texts.values()))))
    for r in Q.QUERIES["op13_alignment"](spark, SF).collect():
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == (*w[:4], *w[5:])
        assert r["groups_sha256"] == (hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "")


def whitened_by_hand(vectors, k=4):
    """(n, deviations, whitened up to sign, explained) by integers of any size and a plain eigendecomposition."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    y = [[n * v[j] - sums[j] for j in range(d)] for v in fit]
    v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    top = np.argsort(-e)[:k]
    rows = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], rows @ q[:, top] / np.sqrt(e[top]), e[top] / np.trace(v)


def test_op12_on_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    n, deviation, want, explained = whitened_by_hand([r["embedding"] for r in good])
    got = Q.QUERIES["op12_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by_row = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        own = np.array([by_row[r["vec_id"], k + 1]["whitened"] for r in good])
        assert min(np.abs(own - want[:, k]).max(), np.abs(own + want[:, k]).max()) < 1e-8
        assert abs(by_row[good[0]["vec_id"], k + 1]["explained"] - explained[k]) < 1e-12
    assert [by_row[r["vec_id"], 1]["deviation"] for r in good] == deviation


def test_whitening_of_awkward_rows(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(0, 1e9, (200, 5)))]
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] + [0.0] * 4), (504, []), (505, [1.0, 2.0]), (506, [-0.0, 0.0, 1e-9, -1e-9, 2.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"x": F.lit("mine"), "n": F.lit(1), "whitened": F.lit(0)}).repartition(5)
    got = whitening.embedding_whitening(df).collect()
    kept = [r for r in rows + odd if r[1] and len(r[1]) == 5 and all(c is not None and np.isfinite(c) for c in r[1])]
    assert len(got) == 4 * len(kept) == 4 * 203
    n, deviation, want, _ = whitened_by_hand([v for _, v in kept])
    assert n == 201 and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation) and max(deviation) > 1 << 63
    first = sorted(abs(r["whitened"]) for r in got if r["component"] == 1)
    assert np.allclose(first, sorted(np.abs(want[:, 0])), atol=1e-9)
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.embedding_whitening(spark.createDataFrame(few, "vec_id long, embedding array<float>")).count() == 0
    # On a line there is one component.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {(r["component"], round(r["explained"], 9)) for r in whitening.embedding_whitening(line).collect()} == {(1, 1.0)}


def test_digit_slices_are_exact():
    draw = np.random.default_rng(5)
    for most in (1, 1 << 15, 1 << 40, 1 << 61):
        y = draw.integers(-most, most, (300, 7), endpoint=True)
        plain = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(7)] for i in range(7)]
        assert whitening.gram(y).tolist() == plain == whitening.gram(y.astype(object)).tolist()
        assert [int(v) for v in whitening.squares(y)] == [sum(int(c) ** 2 for c in r) for r in y]
    big = np.array([(1 << 200) - 7, -(1 << 200) + 3, -1, 0], object)
    assert [sum(int(w[i].as_py()) << (whitening.WORD * k) for k, w in enumerate(whitening.words(big))) for i in range(4)] == big.tolist()
