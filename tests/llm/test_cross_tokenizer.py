"""Alignment of two tokenizers against brute force over the tokenizer files."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from answerbank.llm import cross_tokenizer as X

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "  x", "Hello  world\n\n end ", "naïve ｆｕｌｌ 世界 🙂🙂 x​y", "<s>a</s><|endoftext|> b <unk>", "▁x ▁", "a\tb\x00c\r\n",
    "x" * 3000, " \n" * 700, "1234567890 " * 40, "it's 'll re-do this", "ǅ ﬁ é", "🙂" * 200,
]


def brute(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}

    def a_bytes(k):
        return bytes(letters[c] for c in tok.id_to_token(k))

    def b_bytes(k):
        p = pieces.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode()

    out, held = [], Counter()
    for key, text in rows:
        raw = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            out.append((key, [], [], []))
            continue
        groups, at, i, j = [], 0, 0, 0
        ends_a, ends_b = np.cumsum([len(a_bytes(k)) for k in a]).tolist(), np.cumsum([len(b_bytes(k)) for k in b]).tolist()
        for cut in sorted(set(ends_a) & set(ends_b)):
            mine, theirs = [k for k, e in zip(a, ends_a) if at < e <= cut], [k for k, e in zip(b, ends_b) if at < e <= cut]
            groups.append((mine, theirs))
            at = cut
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
        out.append((key, a, b, groups))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    final = []
    for key, a, b, groups in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        final.append((key, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return final


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_odd_texts_and_repeated_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(k // 2 if k != 5 else None, t) for k, t in enumerate(ODD_TEXTS)] + [(90, "same words here " * 30)] * 5
    rows += [(100 + k, "".join(rng.choice("ab1 \n\t'é.,世 ") for _ in range(rng.randint(1, 200)))) for k in range(60)]
    docs = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, block int, pairs string, n_a int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(X.aligned_documents(spark, str(tmp_path)).collect()) == ordered(brute(rows))
    assert X.linked_counts(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(X.linked_counts(docs).collect()) == ordered(brute(rows))
    shown = {r["doc_id"]: r["groups"] for r in X.alignments(docs).collect()}
    digests = {r[0]: r[-1] for r in brute(rows)}
    assert all((hashlib.sha256(g.encode()).hexdigest() if g else "") == digests[k] for k, g in shown.items())


def test_small_blocks_and_memo_change_nothing():
    tools = X.load_tokenizers(X.SIDE_A, X.SIDE_B)
    import pyarrow as pa

    texts = ["one two three two one", "two one, two", "", "three"] * 3
    whole, small = X.Block(), X.Block()
    whole.add(pa.array(range(12)), texts, tools, {}, True)
    for k, text in enumerate(texts):
        small.add(pa.array([k]), [text], tools, {}, True)
    (docs, block), (others, other) = whole.rows(0), small.rows(0)
    assert [d["groups"] for d in docs] == [d["groups"] for d in others]
    assert dict(zip(block["pairs"], block["held_by"])) == dict(zip(other["pairs"], other["held_by"]))


def test_huge_groups_and_varints(monkeypatch):
    import pyarrow as pa

    tools = X.load_tokenizers(X.SIDE_A, X.SIDE_B)
    texts = ["🙂🙂 世界 naïve naïve", "it's re-do", "x" * 300]
    plain, split = X.Block(), X.Block()
    plain.add(pa.array([0, 1, 2]), texts, tools, {}, True)
    monkeypatch.setattr(X, "HUGE", 1)
    split.add(pa.array([0, 1, 2]), texts, tools, {}, True)
    for x, y in zip(plain.held, split.held):
        assert all((p == q).all() for p, q in zip(x, y))
    values = np.array([0, 1, 127, 128, 300, 2**31, 2**40, 5], dtype=np.int64)
    data, sizes = X.varints(values)
    assert X.from_varints(data.tobytes()).tolist() == values.tolist() and sizes.sum() == len(data)


def test_equal_hashes_of_other_ids_are_told_apart(monkeypatch):
    tools = X.load_tokenizers(X.SIDE_A, X.SIDE_B)
    monkeypatch.setattr(X.Side, "hashes", lambda self, factor: np.zeros(len(self.low), np.uint64))
    import pyarrow as pa

    texts = ["one two three two one", "two one, two"]
    forced, plain = X.Block(), X.Block()
    forced.add(pa.array([0, 1]), texts, tools, {}, True)
    monkeypatch.undo()
    plain.add(pa.array([0, 1]), texts, tools, {}, True)
    assert [d["groups_sha256"] for d in forced.docs] == [d["groups_sha256"] for d in plain.docs]
