"""Operators of the training-data subpackage against brute force, round trips and odd tables."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np

from answerbank.llm import ann_collision, bpe_tree, html_template, jaccard_join, langid, line_dedup, merkle, packing, pii_feistel, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, rank int"
ODD = [
    (None, "no id " * 30, "en", "s", 1, 0.5, 1, 2),
    (5, None, None, None, None, None, None, None),
    (4, "", "en", "s", 0, None, None, None),
    (9, "same text with some words in it " * 8, "en", "s", 9, None, None, None),
    (7, "same text with some words in it " * 8, "en", "s", 9, None, None, None),
    (7, "same text with some words in it " * 8, "en", "s", 9, None, None, None),
    (11, "x" * 30000, "de", "s", 9, None, None, None),
    (12, " \n\t" * 50, "de", "s", 9, None, None, None),
    (13, "12 34 !!", "fr", "s", 9, None, None, None),
]


def every(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    return odd, odd.limit(0)


def test_odd_and_empty_tables(spark):
    operators = {
        "bpe": lambda d: bpe_tree.encode_column(d, "byte_bpe_multi_50k.tiktoken"),
        "merkle": merkle.fingerprints,
        "langid": lambda d: langid.predict(d, langid.train(d)),
        "lines": line_dedup.remove_repeats,
        "suffix": suffix_dedup.without_repeats,
        "pii": pii_feistel.pseudonymised,
        "packing": lambda d: packing.pack(packing.token_pieces(d)).select("doc_id", "piece").filter("piece = 0"),
        "jaccard": jaccard_join.linked,
    }
    for name, operator in operators.items():
        odd, empty = every(spark)
        assert operator(empty).count() == 0, name
        assert operator(odd).count() == len(ODD), name


def test_tree_encodes_as_one_piece():
    encoding = bpe_tree.load_encoding("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(1)
    texts = ["", " " * 5000 + "x", "a" * 3000, "日本語" * 90, "'s't" * 90] + ["".join(rng.choice("ab1 \n\t 'é.,世") for _ in range(300)) for _ in range(40)]
    for leaf, window in ((1, 1), (7, 2), (64, 8)):
        tree = bpe_tree.MergeTree(encoding, leaf, 5, window)
        for text in texts:
            ids = tree.encode(text)
            assert ids.tolist() == encoding.encode_ordinary(text) and tree.decode(ids) == text.encode()


def test_rank_file_gives_the_tokenizer_files_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    encoding = bpe_tree.load_encoding("byte_bpe_50k.tiktoken")
    for text in ("a<|endoftext|>b", "naïve 世界  x y​ z", "it's  12½ ٣٤ \x1c\x85 end\n\n", "𝔘𝔫𝔦 🙂🙂"):
        assert reference.encode(text, add_special_tokens=False).ids == encoding.encode_ordinary(text)


def test_pieces_have_the_tokenizer_files_ids(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x", f"tail  {end}\n\n y", f"two  {end}  three {end[:-1]} {end.upper()}", f"é{end}" * 700, "none of it"]
    texts.append("word " * 3000 + end + " \n" * 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.token_pieces(docs).collect()}
    wanted = {}
    for k, text in enumerate(texts):
        ids = [*reference.encode(text, add_special_tokens=False).ids, packing.END_ID]
        cuts = [0, *range(len(ids) % packing.CAPACITY or packing.CAPACITY, len(ids) + 1, packing.CAPACITY)]
        for low, high in zip(cuts, cuts[1:]):
            wanted[k, low] = (high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes()))
    assert found == wanted


def test_html():
    page = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>cookies</div><nav><a>menu</a></nav>"
        "<main><header><h1>Real title</h1></header><p>First &amp; one<br>two&nbsp;three</p><aside>see</aside><p>Next <script>x<y</script>"
        "<form><label>mail</label></form><ul><li>a<li>b</ul><div id=comments><p>nice</p></div></main><footer>f</footer></body>"
    )
    assert html_template.main_text(page, set(), None, {}) == "Real title\n\nFirst & one two three\n\nNext\n\na\n\nb"
    assert html_template.main_text("", set(), None, {}) == ""
    assert html_template.main_text("<p>cut off &am<art", set(), None, {}) == "cut off &am"


def test_template_text_goes(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div><p>Shared words</p><p>own {k}</p><p>more {k * 7}</p></div></body>") for k in range(9)]
    pages += [(99, None, "<body><p>alone</p></body>"), (None, "http://h.example/x", None)]
    found = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[99] == "alone" and found[None] == ""
    assert all("own" in found[k] for k in range(9))


def test_text_that_pages_share_stays(spark):
    top, end = "<div>Home of all things</div>", "<div>Made with care</div>"
    pages, wanted = [], {}
    for k in range(12):  # a passage on all pages
        own = f"Own words of page {k} " * 5
        pages.append((k, f"http://a.example/{k}", f"<html><body>{top}<article><h2>Series</h2><p>{own}</p><p>Shared words</p></article>{end}</body></html>"))
        wanted[k] = f"Series\n\n{own.strip()}\n\nShared words"
    same = [f"Paragraph {k} of the copied text " * 4 for k in range(4)]
    for tag, close, host, base in (("<article>", "</article>", "b", 100), ("<div class=text>", "</div>", "c", 200)):
        for k in range(12):  # near copies on half of the host, with a list that the others lack
            texts = [*same, f"copy {k}"] if k % 2 else [f"Other words {k} {j} " * 4 for j in range(5)]
            body = "".join(f"<p>{x}</p>" for x in texts) + ("<ul><li>An item</li></ul>" if k % 2 else "")
            pages.append((base + k, f"http://{host}.example/{k}", f"<html><body>{top}{tag}{body}{close}{end}</body></html>"))
            wanted[base + k] = "\n\n".join([x.strip() for x in texts] + ["An item"] * (k % 2))
    found = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == wanted


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann_collision.nearest(table, table.filter("vec_id % 20 = 0"), 10).collect()
    hits = 0
    for q in range(0, 600, 20):
        values = vectors @ vectors[q]
        values[q] = -np.inf
        best = set(np.argsort(-values)[:10].tolist())
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert all(abs(r[2] - values[r[1]]) < 1e-9 for r in mine)
        hits += len(best & {r[1] for r in mine})
    assert hits >= 0.9 * 300
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert ann_collision.nearest(few, few, 20).count() == 12


def test_feistel_reads_back():
    feistel = pii_feistel.Feistel(b"k")
    values = "a.b7@mail6.example.com|4111 1111 1111 1111|5927243074273351|97.51.17.173|2024-02-29|31.12.1999|123-45-6789|+1 (017) 555-7713"
    for value in (values + "|DE89 3704 0044 0532 0130 00|" + "0f" * 20).split("|"):
        text, n = pii_feistel.replace(feistel, f"x {value}, y")
        assert n == 1 and value not in text and len(text) >= 5
        assert pii_feistel.replace(feistel, text, True)[0] == f"x {value}, y"
    assert pii_feistel.replace(feistel, "CC BY 4.0, 2024 and 1.2") == ("CC BY 4.0, 2024 and 1.2", 0)
    card = re.sub(r"\D", "", pii_feistel.replace(feistel, "4111 1111 1111 1111")[0])
    assert pii_feistel.luhn_digit([int(c) for c in card[:-1]]) == int(card[-1])


def test_values_with_words_behind_them():
    feistel, rng = pii_feistel.Feistel(b"k"), random.Random(8)
    examples = ["BE68 5390 0754 7034", "AT611904300234573201", "ES9121000418450200051332", "555 123 4567", "555 123-4567", "AB12" + "0F3D" * 7]
    for country, length in pii_feistel.IBAN_LENGTHS.items():
        body = "".join(rng.choice("0123456789") for _ in range(length - 4))
        compact = f"{country}{98 - pii_feistel.iban_remainder(country + '00' + body):02d}{body}"
        examples += [compact, " ".join(compact[k : k + 4] for k in range(0, length, 4))]
    for value in examples:
        for behind in ("", ", ", " EUR", " 2024", " EUR 2024", " IN FULL ON TIME", " BE68 5390 0754 7034 EUR"):
            if behind[1:3] in ("20", "BE") and value[0] == "5":
                continue
            text, n = pii_feistel.replace(feistel, f"to {value}{behind}")
            assert n == 1 + ("BE68" in behind) and value not in text and len(text) == len(f"to {value}{behind}")
            assert "5390 0754" not in text if "BE68" in behind else text.endswith(behind)
            assert pii_feistel.replace(feistel, text, True) == (f"to {value}{behind}", n)
    text, n = pii_feistel.replace(feistel, "REF AB13 3456 7890 BE68 5390 0754 7034 EUR")
    assert n == 1 and text.startswith("REF AB13 3456 7890 BE") and "5390 0754" not in text
    assert pii_feistel.replace(feistel, "ID AB13 3456 7890 EUR") == ("ID AB13 3456 7890 EUR", 0)


def test_fingerprints(spark):
    rows = [(k, t) for k, t in ((3, "one\ntwo\nthree " * 9), (1, "abcdefgh" * 20), (2, "abcdefgh" * 20), (8, ""))]
    found = {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    for k, (key, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert found[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[key].n_chars == len(text)
    assert found[1].fingerprint == found[2].fingerprint != found[3].fingerprint and found[1].near_next == 1.0
    assert found[3].near_edited > 0.5 and found[3].near_next == 0.0


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter(langid.held_out(found.doc_id)).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_shares_do_not_depend_on_the_batch():
    import pyarrow as pa

    # Languages a and b have the same letters, so two languages are no better than one for a text of a and c; three are.
    rng = random.Random(9)
    letters = ("abcdefgh", "abcdefgh", "qrstuvwx", "yz012345")
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    counts = np.full((langid.BUCKETS, 4), langid.SMOOTHING)
    for k in (0, 2, 3):
        np.add.at(counts[:, k], langid.trigrams(pa.array([text(k, 4000)]))[0], 1)
    counts[:, 1] = counts[:, 0]
    model = langid.Model(tuple("abcd"), np.log(counts / counts.sum(axis=0)).astype(np.float32))
    mixed = text(0, 140) + " " + text(2, 60)
    texts = [mixed, text(2, 90) + " " + text(3, 60), text(3, 40), "", mixed]
    together = langid.mixtures(model, pa.array(texts))
    for k, one in enumerate(texts):
        assert np.array_equal(langid.mixtures(model, pa.array([one]))[0], together[k])
    assert together[0][2] > 0.2 and together[0][3] == 0


def jaccard_brute(docs, width, least):
    sets = []
    for _, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        whole = {tuple(found)} if found else set()
        sets.append({tuple(found[k : k + width]) for k in range(len(found) - width + 1)} if len(found) >= width else whole)
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    smallest = {}
    for k, (key, _) in enumerate(docs):
        smallest[top(k)] = min(smallest.get(top(k), key), key)
    return {key: (len(sets[k]), smallest[top(k)]) for k, (key, _) in enumerate(docs)}


def test_jaccard(spark):
    rng = random.Random(5)
    base = [[f"{rng.choice('abcdef')}{rng.randint(0, 30)}" for _ in range(rng.choice((1, 2, 40, 70)))] for _ in range(12)]
    docs = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = f"Z{rng.randint(0, 400)}"
        docs.append((3 * k + 1, rng.choice(["", None]) if rng.random() < 0.02 else " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(table, 3, Fraction(9, 10)).collect()}
    assert found == jaccard_brute(docs, 3, Fraction(9, 10))


def test_jaccard_of_a_family_round_the_threshold(spark):
    """One family whose texts mostly differ by about the threshold: links inside it are found by stars and by the join after them."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(90)]
    docs = []
    for k in range(260):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 60)}"
        docs.append((7 * k + 2, " ".join(words)))
    docs += [(4000 + k, " ".join(base[: 70 + k])) for k in range(20)]
    found = jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), 5, Fraction(8, 10)).collect()
    expected = jaccard_brute(docs, 5, Fraction(8, 10))
    assert len({c for _, c in expected.values()}) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_parity_words_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        shared, mine, other = (rng.integers(0, 1 << 48, rng.integers(0, 90), dtype=np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate((shared, mine))), np.unique(np.concatenate((shared, other)))
        x, y = (jaccard_join.parity_words(jaccard_join.mix64(s)) for s in (a, b))
        differing = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y))
        assert len(x) == len(jaccard_join.PARITY) and differing <= len(np.setxor1d(a, b))


def test_bytes(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice((10, 49, 50, 51, 120)))) for _ in range(20)] + ["a" * 120, "ab" * 60]
    docs = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for k in range(120)] + [(300, None)]
    first = {}
    for key, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], key)
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < key:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, out in zip(data, gone) if not out)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        r = found[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(data), sum(gone), spans, kept)


def test_bytes_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice((49, 50, 60, 120)))) for _ in range(14)]
    docs = [(rng.choice((None, None, 3, 4, 5, 6, 7, 8)), "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for _ in range(90)]
    docs += [(1, pool[0] + pool[1]), (None, pool[0] + pool[1]), (None, "only here " * 9), (2, "x" * 70), (2, pool[2] + pool[0])]
    first = {}
    for key, text in docs:
        data = text.encode()
        for p in range(len(data) - 49):
            first[data[p : p + 50]] = min(first.get(data[p : p + 50], 1 << 63), 1 << 62 if key is None else key)
    wanted = []
    for key, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < (1 << 62 if key is None else key):
                gone[p : p + 50] = b"\1" * 50
        wanted.append((str(key), len(data), bytes(x for x, out in zip(data, gone) if not out)))
    found = suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in found) == sorted(wanted)


def test_lines(spark):
    rng = random.Random(3)
    pool = ["", "a", "bb", "é" * 30, "dd dd", "x" * 40, "y" * 7]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    found = {r.doc_id: r.text for r in line_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 30).collect()}
    first = {}
    runs = [(k, text.split("\n")) for k, text in docs]
    for k, lines in runs:
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                first.setdefault(tuple(lines[p:q]), (k, p))
    for k, lines in runs:
        gone = set()
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                if sum(len(x) + 1 for x in lines[p:q]) >= 30 and first[tuple(lines[p:q])] < (k, p):
                    gone |= set(range(p, q))
        assert found[k] == "\n".join(x for j, x in enumerate(lines) if j not in gone)


def test_packing(spark):
    lengths = np.random.default_rng(4).integers(1, 1025, 3000)
    table = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(table, per_partition=300).toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert len(rows) == 3000 and (ends - rows.length == rows.offset).all() and ends.max() <= 1024
    assert rows.sequence_id.nunique() <= packing.bin_bound(lengths, 1024) * 1.03 + 1
    assert packing.bin_bound(np.array([600] * 5), 1024) == 5


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    sizes = rows.groupBy("sequence_id").sum("length").toPandas()
    assert len(sizes) and sizes["sum(length)"].max() <= 1024


def test_parity_words_tell_long_sets_apart():
    """256 bits can differ in 128 places on average, sets of 1000 tokens may at a similarity of 0.8 in 222: all such pairs were made."""
    rng = np.random.default_rng(17)
    num, den = 8, 10
    for shared, link in ((750, False), (500, False), (900, True), (960, True)):
        tokens = rng.integers(0, 1 << 48, size=2000 - shared, dtype=np.uint64)
        x, y = (jaccard_join.parity_words(jaccard_join.mix64(t)) for t in (tokens[:1000], tokens[1000 - shared :]))
        differing = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x, y))
        assert (differing * (num + den) <= 2000 * (den - num)) == link


def test_pairs_meet_at_tokens_that_others_hold(spark, monkeypatch):
    """Tokens of one holder took the places of shared ones, so pairs of long documents were made at every shared token."""
    common = " ".join(f"s{k}" for k in range(48))
    rows = [(d, f"{common} " + " ".join(f"u{d}x{k}" for k in range(6))) for d in range(6)]
    kept, real = [], jaccard_join.stored

    def stored(df):
        out = real(df)
        if "lowest" in df.columns:
            kept.append(out)
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.linked(docs, 5, Fraction(8, 10)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: d for d in range(6)}
    places = kept[0].collect()
    assert places and all(sum(t == p["token"] for p in places) > 1 for r in places for t in r["lowest"])
