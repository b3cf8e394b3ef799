import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellquarry.llm import bpecount, langid, linededup, mixture, passages, pieces, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h int"
BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, **more):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, more.get("lang", lambda i: "en")(i), more.get("source", lambda i: f"src{i % 3}")(i), len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n\n", "a", "word " * 5000, "ab▁c \x00 é日😀", "x" * 30000]


# ---- token counts


def test_counts_equal_the_library(spark):
    rng = random.Random(1)
    letters = "aaab 's't\n\t\x1c\x85　é日本😀12_!<|endoftext|>ₐⅷ٣"
    texts = [*ODD, "a<|endoftext|>b", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500))]
    own = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in bpecount.count_tokens(docs(spark, texts), BPE).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_texts_part_as_the_library_parts_them():
    """Every character beside a letter and a CJK sign, and those the regex package takes otherwise beside all kinds."""
    patterns = bpecount.split_patterns(BPE)
    split, library = bpecount.Merger(BPE, patterns).split, Tokenizer.from_file(BPE).pre_tokenizer.pre_tokenize_str
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    strange = [c for c in every if re.match(patterns[1], c)]
    for form, signs in (("a%s榱", every), *((f, strange) for f in ("%s1", "1%s", " %s", "%s!", "%s%s"))):
        text = "\n".join(form.replace("%s", c) for c in signs)
        assert split(text) == [text[a:b] for _, (a, b) in library(text)], form
    own = Tokenizer.from_file(BPE)
    assert bpecount.Merger(BPE, patterns).counts(["\U0001dff6\u69b1"]) == [len(own.encode("\U0001dff6\u69b1").ids)]


def test_chunks_between_blanks_count_like_whole_texts():
    """Known chunks are not parted again, and white space of any kind counts as the library counts it."""
    rng, library = random.Random(14), Tokenizer.from_file(BPE)
    m = bpecount.Merger(BPE, bpecount.split_patterns(BPE))
    bits = [" ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "word", "12", "'s", "'", "!?", "é", "日", "<|endoftext|>"]
    texts = ["", " ", "  ", "a ", "a  ", "a\n ", " \n a", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    assert m.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    parted, usual = [], m.split
    m.split = lambda t: parted.append(t) or usual(t)
    plain = ["one two three, two!"] * 50
    assert m.counts(plain) == m.counts(plain)
    assert sum(map(len, parted)) < sum(map(len, plain))


def test_counts_of_nothing_and_repeats(spark):
    assert bpecount.count_tokens(docs(spark, []), BPE).count() == 0
    d = docs(spark, ["one two"])
    twice = d.union(d).union(d.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id is None, r.n_tokens) for r in bpecount.count_tokens(twice, BPE).collect()) == [(False, 2), (False, 2), (True, 2)]


# ---- pieces


def test_pieces_are_lossless_and_reproducible(spark):
    d = docs(spark, ODD)
    one = {r.doc_id: r for r in pieces.encode_pieces(d, MODEL).collect()}
    two = {r.doc_id: r for r in pieces.encode_pieces(d.repartition(3), MODEL).collect()}
    assert {k: v.pieces for k, v in one.items()} == {k: v.pieces for k, v in two.items()}
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(d, MODEL), MODEL).collect()}
    assert back == dict(enumerate(ODD))
    assert one[0].pieces is None and one[1].pieces == [] and one[0].n_pieces == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sp.decode(one[5].pieces) == ODD[5]
    assert pieces.encode_pieces(docs(spark, []), MODEL).count() == 0


def test_sampling_follows_the_lattice():
    """Frequencies of sampled segmentations against all segmentations by brute force."""
    lat = pieces.lattice(MODEL, 1.0)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    word = "▁this"
    weight = {}

    def split(at, done, score):
        if at == len(word):
            weight[done] = np.exp(score)
            return
        for end in range(at + 1, len(word) + 1):
            i = sp.piece_to_id(word[at:end])
            if sp.id_to_piece(i) == word[at:end] and not sp.is_unknown(i):
                split(end, (*done, i), score + lat.worth[i])

    split(0, (), 0.0)
    n = 40000
    ids, sizes = lat.encode(["this"] * n, [pieces.row_seed(i, 5) for i in range(n)])
    seen, at = {}, 0
    for s in sizes.tolist():
        k = tuple(ids[at : at + s].tolist())
        seen[k] = seen.get(k, 0) + 1
        at += s
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for k, w in weight.items():
        p = w / total
        assert abs(seen.get(k, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_long_texts_part_at_words(monkeypatch):
    lat, text = pieces.lattice(MODEL, 1.0), "some words  and   blanks\n" * 40
    whole = lat.encode([text], [9])[0]
    monkeypatch.setattr(pieces, "LONGEST_PART", 50)
    assert (lat.encode([text], [9])[0] == whole).all()


def test_long_words_are_sampled_in_chunks(spark, monkeypatch):
    """The same pieces whatever the chunk; the same share of segmentations as words in one go; blanks, marks and bytes come back."""
    lat, rng = pieces.lattice(MODEL, 1.0), random.Random(3)
    word = "\x00" + "".join(rng.choice("thisngé😀▁") for _ in range(3000))
    whole = lat.long_word(word, 5)
    assert all((lat.long_word(word, 5, chunk) == whole).all() for chunk in (37, 1000)) and lat.long_word(word, 6).tolist() != whole.tolist()
    n, short, long_ = 3000, {}, {}
    ids, sizes = lat.encode(["this"] * n, [pieces.row_seed(i, 5) for i in range(n)])
    for k in np.split(ids, np.cumsum(sizes)[:-1]):
        short[tuple(k.tolist())] = short.get(tuple(k.tolist()), 0) + 1
    for i in range(n):
        k = tuple(lat.long_word("\x00this", pieces.row_seed(i, 9)).tolist())
        long_[k] = long_.get(k, 0) + 1
    assert all(abs(short.get(k, 0) - long_.get(k, 0)) < 5 * np.sqrt(short.get(k, 0) + long_.get(k, 0) + 1) for k in {*short, *long_})
    monkeypatch.setattr(pieces, "LONGEST_PART", 40)
    for t in ("x" * 500, " " * 300 + "a" * 300, "a b " + "é😀▁" * 90 + " c d" * 30 + " " * 100, "short"):
        ids, size = lat.encode([t, "end"], [1, 2])
        assert lat.decode(ids[: size[0]]) == (" " + t).encode() and size.sum() == len(ids)


def test_pieces_of_odd_rows(spark):
    d = docs(spark, ["one two", "y" * 600_000])
    d = d.unionByName(d.where("doc_id = 0")).unionByName(d.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"pieces": F.lit(1), "n_pieces": F.lit(2)})
    got = pieces.encode_pieces(d, MODEL, keep=True)
    assert set(got.columns) == {*d.columns} and got.schema["pieces"].dataType.simpleString() == "array<int>"
    rows = got.collect()
    assert sum(r.doc_id is None for r in rows) == 1 and len({tuple(r.pieces) for r in rows if r.doc_id == 0}) == 1 and rows[0].fp == "x"
    assert {r.text for r in pieces.decode_pieces(got, MODEL).collect()} == {"one two", "y" * 600_000}


# ---- line dedup


def by_hand(texts, size=3):
    seen, out = set(), []
    for t in texts:
        lines = [] if t is None else t.split("\n")
        drop = set()
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if not any(x.strip(" \t\r") for x in w):
                continue
            if w in seen:
                drop |= set(range(i, i + size))
            seen.add(w)
        out.append(t if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
    return out


def test_lines_against_a_scan(spark):
    rng = random.Random(3)
    texts = [None, "", "\n\n\n\n", *("\n".join(rng.choice(["a", "b", "c", ""]) for _ in range(rng.randint(0, 9))) for _ in range(150))]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i].text for i in range(len(texts))] == by_hand(texts)
    assert all(got[i].n_chars == len(got[i].text or "") and got[i].h == 1 for i in got)
    assert linededup.dedup_lines(docs(spark, [])).columns == docs(spark, []).columns


def test_lines_without_id_or_with_repeats(spark):
    d = docs(spark, ["a\nb\nc", "a\nb\nc\nd"])
    got = linededup.dedup_lines(d.union(d).union(d.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 9, r.text) for r in got) == [(0, "a\nb\nc"), (0, "a\nb\nc"), (1, "d"), (1, "d"), (9, "a\nb\nc"), (9, "a\nb\nc\nd")]


# ---- SimHash


def slow_print(text):
    words = [w for w in simhash.WORD.findall((text or "").encode().lower())]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts = [*ODD, *base]
    for t in base * 2:
        w = t.split(" ")
        if len(w) > 10:
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += base[:10]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fp = [slow_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fp
    comp = list(range(len(texts)))
    for _ in comp:
        new = [min(comp[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == comp:
            break
        comp = new
    assert [got[i].component_id for i in range(len(texts))] == comp
    kept = simhash.one_of_each(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(comp)) and kept[0].fp == "x"
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_trie_links_in_dense_balls():
    rng = np.random.default_rng(2)
    for bits in (0, 3, 13):
        fp = rng.integers(0, 2**63, 30).astype(np.uint64)[rng.integers(0, 30, 300)]
        for _ in range(4):
            fp = fp ^ np.where(rng.random(300) < 0.6, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
        fp = np.unique(fp)
        root = (fp >> np.uint64(64 - bits) if bits else fp * np.uint64(0)).astype(np.int64)
        a, b = np.triu_indices(len(fp), 1)
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= 4) & (root[a] == root[b])
        want = simhash.least_label(np.arange(len(fp)), a[near], b[near])
        assert (simhash.trie_links(fp, root, bits, 4, most=64) == want).all()


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_any_number_of_blocks_finds_all_links(spark, blocks):
    rng = np.random.default_rng(blocks)
    fp = rng.integers(-(2**63), 2**63 - 1, 60)
    near = fp.copy()
    for _ in range(4):
        near = near ^ (np.int64(1) << rng.integers(0, 63, 60))
    all_ = np.unique(np.concatenate([fp, near]))
    edges = simhash.near_edges(spark.createDataFrame([(i, int(f)) for i, f in enumerate(all_)], "node long, fp long"), 4, blocks=blocks)
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    a, b = np.triu_indices(len(all_), 1)
    linked = np.bitwise_count((all_[a] ^ all_[b]).view(np.uint64)) <= 4
    want = simhash.least_label(np.arange(len(all_)), a[linked], b[linked])
    assert [got.get(i, i) for i in range(len(all_))] == want.tolist()
    assert simhash.blocks_for(10**6, 4) == 5 and simhash.blocks_for(10**9, 4) == 6 and simhash.blocks_for(10**11, 4) == 7


def test_groups_with_null_and_repeated_ids(spark):
    d = docs(spark, ["one two three four five", "one two three four five"])
    d = d.union(d.where("doc_id = 1")).union(d.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()} == {(0, 0), (1, 0), (None, 0)}
    assert sorted(r.doc_id is None for r in simhash.one_of_each(d).collect()) == [False, True]


def near_texts(n, words=60, seed=3):
    """Texts whose fingerprints are a few bits apart from the first, in a chain."""
    rng = random.Random(seed)
    out = [[f"w{rng.randrange(500)}" for _ in range(words)]]
    while len(out) < n:
        w = [*out[-1]]
        w[rng.randrange(words)] = f"z{rng.randrange(99)}"
        if 0 < (slow_print(" ".join(w)) ^ slow_print(" ".join(out[-1]))).bit_count() <= 4:
            out.append(w)
    return [" ".join(w) for w in out]


def test_rows_without_an_id_link_and_bridge(spark):
    texts = near_texts(12)
    fp = [slow_print(t) for t in texts]
    i, j, k = next((i, j, k) for i in range(12) for j in range(12) for k in range(12) if (fp[i] ^ fp[j]).bit_count() <= 4 and (fp[j] ^ fp[k]).bit_count() <= 4 < (fp[i] ^ fp[k]).bit_count())
    d = spark.createDataFrame([(5, texts[i]), (None, texts[j]), (9, texts[k]), (7, "far away from all of these"), (7, texts[k]), (None, "so is this one, on its own")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(d).collect()}
    name = lambda f: f"{f:016x}"
    assert got[5, name(fp[i])] == got[None, name(fp[j])] == got[9, name(fp[k])] == got[7, name(fp[k])] == 5
    assert got[7, name(slow_print("far away from all of these"))] == 7 and got[None, name(slow_print("so is this one, on its own"))] is None
    clash = d.withColumns({"kept_id": F.lit(1), "KEPT_ID_": F.lit(2), "component_id": F.lit(3), "fp": F.lit(4)})
    kept = simhash.one_of_each(clash).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, texts[j]), (-1, "so is this one, on its own"), (5, texts[i]), (7, min("far away from all of these", texts[k]))])
    assert kept[0].kept_id == 1 and len(kept[0]) == 6


# ---- language, quality


def test_language(spark):
    words = {"en": ["the", "this", "with", "thing"], "de": ["der", "ich", "und", "nicht"], "fr": ["le", "eau", "être", "vous"]}
    rng, texts, langs = random.Random(4), [], []
    for _ in range(300):
        lang = rng.choice([*words])
        langs.append(lang)
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(30)))
    texts += [None, "", "123 !!", "x" * 20000]
    langs += ["en", None, "de", "fr"]
    got = {r.doc_id: r for r in langid.predict_language(docs(spark, texts, lang=lambda i: langs[i])).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(300) if got[i].held_out]
    assert held and all(got[i].lang_pred == langs[i] for i in held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_language(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.predict_language(docs(spark, ["hello"], lang=lambda i: None)).collect()} == {"und"}


def plain_grams(text):
    """1- to 3-grams of the lower-cased words between edge marks, as code points."""
    words, out = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower())), {}
    line = "_" + "".join(w + "_" for w in words)
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g[:1] == "_" == g or (n == 3 and g[1] == "_"):
                continue
            code = tuple(map(ord, g)) + (0,) * (3 - n)
            out[code] = out.get(code, 0) + 1
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda c: (-counts[c], c))[:size]


def test_language_against_plain_profiles(spark):
    rng, kinds = random.Random(8), {"en": "etaoin shrdlu", "de": "enisra tdhulß", "fr": "esaitn ruloéè"}
    rows = []
    for i in range(160):
        lang = rng.choice([*kinds])
        text = " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 25)))
        rows.append((i, rng.choice([text, text.upper(), text + " 12, é!"]), None if i % 9 == 0 else lang))
    rows += [rows[3], rows[3], (None, rows[5][1], "de"), (1000, None, "en"), (1001, "ÆØ", "xx"), (1002, "ÆØ", "aa"), (1003, "Æ Ø", None)]
    size, counts = 20, {}
    for i, text, lang in rows:
        if lang and text is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            own = counts.setdefault(lang, {})
            for g, n in plain_grams(text).items():
                own[g] = own.get(g, 0) + n
    rank = {lang: {g: r for r, g in enumerate(ranked(c, size))} for lang, c in counts.items()}

    def predict(text):
        grams = ranked(plain_grams(text or ""), size)
        if not grams:
            return "und", 0.0
        far = {lang: sum(abs(i - r[g]) if g in r else size for i, g in enumerate(grams)) for lang, r in rank.items()}
        best = min(sorted(far), key=far.get)
        return best, 1 - far[best] / (size * len(grams))

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit("x"), "code": F.lit(1)})
    got = langid.predict_language(d, size=size).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(((i, *predict(t)) for i, t, _ in rows), key=key)
    assert [(r.doc_id, r.lang_pred) for r in sorted(((r) for r in got), key=lambda r: (r.doc_id is None, r.doc_id, r.lang_pred))] == [w[:2] for w in want]
    assert np.allclose(sorted(r.score for r in got), sorted(w[2] for w in want))
    assert predict("ÆØ")[0] == "aa"  # two languages with one profile: the name that sorts first


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["calm", "clear", "prose", "reads", "well"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["buy!!", "WIN!!", "prose", "CLICK!!"]) for _ in range(40))
    y = [rng.random() < 0.7 for _ in range(300)]
    texts = [good() if v else bad() for v in y] + [None, "", "x" * 20000]
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == y[i] for i in held]) > 0.97
    kept = quality.keep_good(docs(spark, texts), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.5} and kept.columns == docs(spark, []).columns
    none = quality.score_quality(docs(spark, ["a"]), labels.limit(0)).collect()
    assert none[0].score == 0.5
    assert quality.score_quality(docs(spark, []), labels).count() == 0
    once = docs(spark, texts)
    again = once.unionByName(once).unionByName(once.where("doc_id = 3").withColumn("text", F.lit("~ later by name")))
    assert all((a == b).all() for a, b in zip(quality.learn_quality(once, labels), quality.learn_quality(again, labels), strict=True))


def test_dual_descent_is_optimal():
    """The hinge-loss objective against many random neighbours of the solution."""
    rng = np.random.default_rng(0)
    feats = [np.unique(rng.integers(0, 16, 5)) for _ in range(60)]
    y = np.array([int(3 in f or rng.random() < 0.2) for f in feats])
    w, squares = quality.fit(feats, y, bits=4, rounds=3000)
    count = {s: np.ones(16) for s in (0, 1)}
    for f, s in zip(feats, y.tolist(), strict=True):
        count[s][f] += 1
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.zeros((60, 17))
    for i, f in enumerate(feats):
        x[i, f] = r[f] / np.sqrt((r[f] ** 2).sum())
        x[i, 16] = 1
    assert np.allclose(squares, r**2)
    s = np.where(y > 0, 1, -1)
    cost = lambda v: v @ v / 2 + np.maximum(0, 1 - s * (x @ v)).sum()
    own = np.append(np.divide(w[:16], r, out=np.zeros(16), where=r != 0), w[16])
    best = cost(own)
    assert all(cost(own + rng.normal(size=17) * e) >= best - 1e-3 for e in (1e-3, 1e-2, 0.1) for _ in range(50))


# ---- mixture


def plain_spread(budget, weights, room):
    """Shares by weight; what a child has no room for goes round again among its siblings."""
    out, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and room[k] > 0}
    while open_ and budget > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if room[k] <= budget * weights[k] / total}
        if not full:
            return out | {k: budget * weights[k] / total for k in open_}
        for k in full:
            out[k] = room[k]
            budget -= room[k]
        open_ -= full
    return out


def plain_budgets(supply, total, weights, epochs):
    out = {}

    def down(path, budget):
        if len(path) == 3:
            out[path] = int(budget + 1e-6)
            return
        children = {leaf[: len(path) + 1] for leaf in supply if leaf[: len(path)] == path}
        room = {c: epochs * sum(n for leaf, n in supply.items() if leaf[: len(c)] == c) for c in children}
        for c, b in plain_spread(budget, {c: weights.get(c, 1.0) for c in children}, room).items():
            down(c, b)

    down((), min(total, epochs * sum(supply.values())))
    return out


def tree(spark, supply, share, weights, epochs):
    d = spark.createDataFrame([(*k, n) for k, n in supply.items()], "d string, l string, s string, n long")
    return {(r.d, r.l, r.s): r.budget for r in mixture.budgets(d, share, weights, epochs).collect()}


def test_budgets(spark):
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 1000}
    assert tree(spark, supply, 200 / 1210, {}, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "x", "4"): 100}
    got = tree(spark, {("a", "x", "1"): 10, ("a", "y", "3"): 20, ("b", "x", "4"): 1000}, 200 / 1030, {}, 1)  # nothing left in a: b takes the rest
    assert got == {("a", "x", "1"): 10, ("a", "y", "3"): 20, ("b", "x", "4"): 170}
    assert tree(spark, supply, 110 / 1210, {("a",): 10.0}, 1)["b", "x", "4"] == 10
    assert sum(tree(spark, supply, 10**6, {}, 2).values()) == 2 * 1210 and tree(spark, {}, 5, {}, 1) == {}


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.7])
def test_budgets_of_many_leaves(spark, share):
    rng = random.Random(int(share * 10))
    supply = {(f"d{rng.randrange(6)}", f"l{rng.randrange(4)}", f"s{i}"): int(10 ** rng.uniform(0, 5)) for i in range(120)}
    weights = {("d1",): 4.0, ("d2",): 0.0, ("d3", "l1"): 0.2, next(iter(supply)): 9.0}
    want, got = plain_budgets(supply, share * sum(supply.values()), weights, 2), tree(spark, supply, share, weights, 2)
    assert {k for k in want if want[k]} <= set(got)
    assert all(abs(want[k] - b) <= 1 for k, b in got.items())


def order_keys(d, whole, seed=11):
    """(key, id, hash) of each row in an epoch's order."""
    key = F.xxhash64(F.lit(seed), F.lit(whole).cast("long"), F.col("doc_id"), F.xxhash64("text"))
    return {r.doc_id: (r.k, r.doc_id, r.m) for r in d.select("doc_id", key.alias("k"), F.xxhash64("text").alias("m")).collect()}


@pytest.mark.parametrize("share, epochs, path", [(0.5, 1, None), (1.0, 2, BPE), (3.0, 2, None)])
def test_mixture_is_the_prefix_of_a_sorted_scan(spark, share, epochs, path):
    rng = random.Random(7)
    texts = ["w " * rng.randint(0, 30) for _ in range(400)] + [None, ""]
    d = docs(spark, texts, lang=lambda i: None if i % 11 == 0 else "de" if i % 4 else "en", source=lambda i: "src0" if i % 3 else f"src{i % 5}")
    clash = d.withColumns({c: F.lit("x") for c in ("domain", "n_tokens", "Epoch", "row", "whole", "d", "mark")})
    got = mixture.mix_sources(clash, F.col("source"), {("src0",): 2.0}, share, epochs, tokenizer_path=path, details=True)
    assert got.columns == [*d.columns, "row", "whole", "d", "mark", "domain", "n_tokens", "epoch"]
    got = got.collect()
    own = Tokenizer.from_file(BPE)
    n = {i: len(own.encode(t or "").ids) if path else len((t or "").split()) for i, t in enumerate(texts)}
    leaf = {r.doc_id: (r.source, r.lang or mixture.NONE, r.source) for r in d.collect()}
    supply = {}
    for i, k in leaf.items():
        supply[k] = supply.get(k, 0) + n[i]
    want = set()
    for k, budget in plain_budgets(supply, share * sum(supply.values()), {("src0",): 2.0}, epochs).items():
        if not supply[k] or not budget:
            continue
        whole, rest = divmod(budget, supply[k])
        mine = [i for i in leaf if leaf[i] == k]
        want |= {(i, e) for i in mine for e in range(whole)}
        held, keys = 0, order_keys(d, whole)
        for i in sorted(mine, key=keys.get):
            if held >= rest:
                break
            want.add((i, whole))
            held += n[i]
    assert {(r.doc_id, r.epoch) for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == n[r.doc_id] and r.domain == r.source for r in got)
    again = mixture.mix_sources(d.repartition(7), F.col("source"), {("src0",): 2.0}, share, epochs, tokenizer_path=path, details=True)
    assert sorted((r.doc_id, r.epoch) for r in again.collect()) == sorted(want)
    assert mixture.mix_sources(docs(spark, []), F.col("source")).count() == 0


def test_mixture_of_equal_rows_keeps_to_its_budget(spark):
    d = docs(spark, ["ten words " * 5], source=lambda i: "a").crossJoin(spark.range(100)).drop("id").withColumn("n_chars", F.monotonically_increasing_id())
    d = d.unionByName(d.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    for share, rows in ((0.25, 50), (0.004, 2), (1.0, 200)):
        out = mixture.mix_sources(d, F.lit(None), share=share, most_epochs=3)
        assert out.count() == rows and out.columns == d.columns
    assert mixture.mix_sources(d, F.lit(None), share=1.255, most_epochs=3).count() == 252  # 125.5 rows a leaf: the 26th is needed


# ---- passages


def prose(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(8)
    passage, texts, planted = prose(rng, 60), [], set()
    for i in range(60):
        w = prose(rng, rng.randint(50, 200))
        if i % 4 == 0:
            own = list(passage)
            if i % 8 == 0:  # fuzzy: replaced, missing and added words
                for k in (11, 29, 47):
                    own[k] = f"new{i}-{k}"
                own.pop(38)
                own.insert(20, f"more{i}")
            at = rng.randrange(len(w))
            w[at:at] = own
            planted.add(i)
        texts.append(" ".join(w))
    texts += [None, "", texts[5], "word " * 3000]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    hit = {r.doc_id for r in got if r.source_doc_id != r.doc_id} | {r.source_doc_id for r in got if r.source_doc_id != r.doc_id}
    assert hit == planted | {5, 62}
    for r in got:
        a, b = texts[r.doc_id].encode()[r.start : r.end].decode(), texts[r.source_doc_id].encode()[r.source_start : r.source_end].decode()
        assert r.n_words == len(a.split()) >= 40 and r.similarity >= 0.8
        if r.similarity == 1:
            assert a.lower() == b.lower()
    assert passages.repeated_passages(docs(spark, [])).count() == 0


@pytest.mark.parametrize("within", [True, False])
def test_every_repeated_run_of_words_is_found(spark, within):
    """Texts are mosaics of shared bits, so most repeated runs hold bits that first stand in different texts."""
    rng = random.Random(12)
    bits = [prose(rng, rng.randint(6, 30)) for _ in range(25)]
    long = [sum(rng.sample(bits, rng.randint(2, 5)), []) for _ in range(12)]
    texts = []
    for i in range(90):
        w = prose(rng, rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            w += (rng.choice(bits) if i < 40 or rng.random() < 0.5 else rng.choice(long)) + prose(rng, rng.choice([0, 0, 9]))
        texts.append(" ".join(w))
    got = passages.repeated_passages(docs(spark, texts), within=within).collect()
    assert within or all(r.doc_id > r.source_doc_id for r in got)
    held = {}
    for r in got:
        a, b = texts[r.doc_id].encode()[r.start : r.end].decode(), texts[r.source_doc_id].encode()[r.source_start : r.source_end].decode()
        assert r.n_words == len(a.split()) >= 40 and r.similarity >= 0.8 and (r.similarity < 1 or a == b)
        at = len(texts[r.doc_id].encode()[: r.start].decode().split())
        held.setdefault(r.doc_id, set()).update(range(at, at + r.n_words))
    seen, runs = {}, 0
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 39):
            key = tuple(w[j : j + 40])
            if key in seen and (within or seen[key][0] != i):
                runs += 1
                assert set(range(j, j + 40)) <= held.get(i, set()), (i, j, seen[key])
            seen.setdefault(key, (i, j))
    assert runs > 300


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("part", [5, 40, 10**6])
def test_seeds_in_parts_keep_their_links(within, part):
    """However the seeds of a bucket are parted, each one stands with an earlier one and all of one hash hang together."""
    rng = np.random.default_rng(part)
    rows = np.unique(np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 9, 400)]), axis=0)  # document, word
    rows = np.column_stack([rows, rng.integers(0, 25, len(rows))])[rng.permutation(len(rows))]
    links, out = passages.Links(within), []
    for i in range(0, len(rows), part):
        d, w, h = rows[i : i + part].T
        out.append(np.column_stack(links.add(d, w, d * 100 + w, h, last=i + part >= len(rows))))
    out = np.vstack(out)
    for h in range(25):
        own = sorted(map(tuple, rows[rows[:, 2] == h][:, :2].tolist()))
        docs_ = {d for d, _ in own}
        if len(own) < 2 or (not within and len(docs_) < 2):
            continue
        mine = [r for r in out.tolist() if (r[0], r[1]) in own]
        assert all(r[2] == r[0] * 100 + r[1] and r[5] == r[3] * 100 + r[4] for r in mine)
        if within:
            assert {(r[0], r[1]) for r in mine} == set(own) and all((r[3], r[4]) <= (r[0], r[1]) for r in mine)
            assert {(r[0], r[1]) for r in mine if (r[3], r[4]) != (r[0], r[1])} == set(own[1:])
        else:
            later = {(r[0], r[1]) for r in mine if r[3] < r[0]}
            assert later >= {x for x in own if x[0] != own[0][0]} if part > len(rows) else {d for d, _ in later} == docs_ - {own[0][0]}
            assert all(r[3] < r[0] or (r[3], r[4]) == (r[0], r[1]) for r in mine)


def test_unsettled_runs():
    """Seeds at words 0, 4 .. 96; those up to 48 first stand in text 7, the others in text 8."""
    w = np.arange(0, 100, 4)
    s = np.where(w <= 48, 7, 8)
    assert passages.unsettled(np.full(25, 9), w, s, w + 100, 5, 8, 40) == ([9], [[14, 51, 62, 68]])
    assert passages.unsettled(np.full(5, 9), w[:5], s[:5], w[:5], 5, 8, 40) == ([], [])
    assert passages.unsettled(w[:0], w[:0], s[:0], w[:0], 5, 8, 40) == ([], [])


def test_seeds_cover_every_run():
    rng = random.Random(9)
    shared = prose(rng, 12)  # k + window - 1
    for _ in range(30):
        a, b = (" ".join(prose(rng, rng.randint(0, 20)) + shared + prose(rng, rng.randint(0, 20))).encode() for _ in range(2))
        doc, _, _, h = passages.seeds([a, b], 5, 8)
        assert set(h[doc == 0]) & set(h[doc == 1])


def test_fenwick_chains_against_all_chains():
    rng = random.Random(10)
    k, cost = 2, 0.1
    for _ in range(60):
        b = np.array(sorted(rng.sample(range(60), rng.randint(2, 9))))
        a = np.array([rng.randrange(60) for _ in b])
        got = max(sum((b[g] - b[f] + k) for f, g in c) - cost * sum((b[n[0]] - b[m[1]] - k) + (a[n[0]] - a[m[1]] - k) for m, n in zip(c, c[1:], strict=False)) for c in passages.chains(b, a, k, cost, 0))
        best = {}
        for i in sorted(range(len(b)), key=lambda i: b[i]):
            joined = [best[j] - cost * ((b[i] - b[j] - k) + (a[i] - a[j] - k)) for j in best if b[j] + k <= b[i] and a[j] + k <= a[i]]
            best[i] = k + max([0.0, *joined])
        assert abs(got - max(best.values())) < 1e-9


def test_edits_against_a_table():
    rng = random.Random(11)
    for _ in range(200):
        x, y = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                t[i][j] = t[i - 1][j - 1] if x[i - 1] == y[j - 1] else 1 + min(t[i - 1][j], t[i][j - 1])
        assert passages.edits(x, y) == t[-1][-1]


def test_fuzzy_passages_are_found_at_their_own_threshold(spark):
    rng = random.Random(3)
    texts, planted = [], set()
    for i in range(150):
        p = prose(rng, 60)
        q = list(p)
        for j in rng.sample(range(60), (6, 7, 9)[i % 3]):
            q[j] = f"new{rng.randrange(10**6)}"
        texts += [" ".join(prose(rng, 50) + x + prose(rng, 50)) for x in (p, q)]
        planted.add(2 * i + 1)
    got = {r.doc_id for r in passages.repeated_passages(docs(spark, texts)).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted)


def test_fuzzy_passage_whose_parts_first_stand_in_several_texts(spark):
    rng = random.Random(5)
    w = prose(rng, 60)
    near = list(w)
    near[20] = near[40] = "replaced"
    texts = [" ".join(x) for x in (w[:20] + prose(rng, 30), prose(rng, 30) + w[20:40], prose(rng, 30) + w[40:], prose(rng, 30) + w, near + prose(rng, 30))]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    assert [(r.doc_id, r.source_doc_id, r.n_words) for r in got if r.doc_id == 4] == [(4, 3, 60)]


def test_fuzzy_passage_whose_parts_also_stand_last_in_several_texts(spark):
    """Neither the first nor the last text with a seed of the copies holds the passage, and no 40 words are equal."""
    rng = random.Random(6)
    w = prose(rng, 60)
    parts = [w[:20], w[20:40], w[40:]]
    near, twice = list(w), list(w)
    near[20] = near[40] = "replaced"
    twice[10] = twice[20] = twice[31] = twice[50] = "again"
    texts = [*(p + prose(rng, 30) for p in parts), prose(rng, 30) + w, *(prose(rng, 30) + p for p in parts), near + prose(rng, 30), *(p + prose(rng, 30) for p in parts), prose(rng, 70) + twice]
    got = {(r.doc_id, r.source_doc_id, r.n_words) for r in passages.repeated_passages(docs(spark, [" ".join(x) for x in texts])).collect()}
    assert (7, 3, 60) in got and (11, 3, 60) in got and {r[0] for r in got} == {7, 11}


def test_pairs_of_seeds_meet_in_every_earlier_text():
    """Seeds 0 .. 39 of two first texts in each of three texts; in the last one a text is known to hold them all."""
    w = np.tile(np.arange(40), 3)
    d, s, sw = np.repeat([5, 6, 7], 40), np.where(w < 20, 1, 2), w + 100
    near = np.zeros(120, np.int64)
    d, w, s, sw, near = (np.concatenate(x) for x in ((d, np.full(60, 7)), (w, np.arange(60)), (s, np.full(60, 6)), (sw, np.arange(60)), (near, np.ones(60, np.int64))))
    found = passages.seams(d, w, 6 * w, s, sw, near, 5, 21, 40, 0.8)
    pairs = sum(15 <= j - i <= 36 for i in range(20) for j in range(20, 40))
    assert np.bincount(found[0], found[4]).tolist() == [0, 0, 0, 0, 0, pairs, pairs, 0] and len(found[0]) == 3 * pairs
    bucket, data = passages.pack_seams(*found, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])
    got = [r for b in passages.link_seams(iter([batch]), 3) for r in b.to_pylist()]
    assert len(got) == pairs and all((r["doc_id"], r["s_doc"]) == (6, 5) and r["at"] == r["s_at"] < 120 <= r["last"] == r["s_last"] for r in got)


def test_large_groups_give_rows_in_proportion(spark):
    """Near copies, and stretches of two words over and over, of many lengths: whole, but not pair by pair."""
    rng = random.Random(15)
    base, texts = prose(rng, 90), []
    for i in range(80):
        w = list(base)
        for j in rng.sample(range(90), 5):
            w[j] = f"new{i}-{j}"
        w.insert(rng.randrange(90), f"more{i}")
        w.pop(rng.randrange(90))
        texts.append(" ".join(w))
    texts += [" ".join(prose(rng, 9) + ["is", "onhe."] * rng.randint(25, 90) + prose(rng, 9)) for _ in range(60)]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    held = {}
    for r in got:
        at = len(texts[r.doc_id].encode()[: r.start].decode().split())
        held.setdefault(r.doc_id, set()).update(range(at, at + r.n_words))
    assert set(range(1, 80)) | set(range(82, 140)) <= set(held) <= set(range(1, 140))
    assert all(len(held[i]) >= 75 for i in range(1, 80)) and all(set(range(9, len(texts[i].split()) - 9)) <= held[i] for i in range(82, 140))
    assert len({(r.doc_id, r.source_doc_id) for r in got}) <= 5 * 140 and len(got) <= 10 * 140


def test_runs_that_repeat_themselves_are_thinned_without_a_gap():
    at = np.array([0, 2, 4, 6, 8, 10, 12, 14, 40, 41, 3, 5])
    key = np.array([7] * 10 + [8, 9], np.uint64)
    assert at[passages.thinned(at, key, 5)].tolist() == [0, 4, 8, 12, 14, 40, 41, 3, 5]
    assert passages.thinned(at[:0], key[:0], 5).tolist() == []


def test_passages_of_one_source_hold_seams_together():
    known = [np.array(c) for c in ([5, 5, 5, 6], [1, 1, 2, 1], [0, 40, 90, 0], [50, 99, 200, 10])]
    d, at, to = (np.array(c) for c in ([5, 5, 5, 5, 6, 6, 7], [0, 45, 60, 95, 0, 0, 0], [99, 99, 120, 200, 10, 11, 5]))
    assert passages.held_by(d, at, to, known).tolist() == [True, True, False, True, True, False, False]
    assert not passages.held_by(d, at, to, [c[:0] for c in known]).any()


def test_segment_that_is_not_similar_enough_is_parted():
    x, y = (np.arange(200, dtype=np.uint64) + np.uint64(n) for n in (0, 0))
    for i in range(60, 180, 20):  # 12 words changed, 8 equal, over and over
        y[i : i + 12] = 1000 + i
    y[20] = 5000
    got = passages.align(x, y, [[0, 195, 0, 195]], 5, 21, 40, 0.8)
    assert [g[:4] for g in got if g[0] == 0] == [(0, 60, 0, 60)]


# ---- rows and columns of all kinds


NAMES = ("domain", "epoch", "n_tokens", "kept_id", "bucket", "data", "h", "raw", "row", "key", "n", "m", "mark", "positions", "f", "y", "score", "held_out", "quality", "source_doc_id", "start", "component_id", "pieces", "n_pieces", "n_bytes", "anchors", "number", "group")


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, "a", "b") for i in range(40)], "doc_id long, quality int, text string, y string")
    return {
        "op2": lambda d: passages.repeated_passages(d, least_words=10),
        "op4": lambda d: pieces.encode_pieces(d, MODEL),
        "op5": lambda d: quality.score_quality(d, labels),
        "op5 stage": lambda d: quality.keep_good(d, labels).select("doc_id", "text"),
        "op6": lambda d: linededup.dedup_lines(d, counts=True).select("doc_id", "text", "n_lines", "n_removed"),
        "op7": lambda d: mixture.mix_sources(d, F.col("source"), details=True).select("doc_id", F.col("domain").alias("leaf"), F.col("n_tokens").alias("size")),
        "op8": lambda d: langid.predict_language(d),
        "op9": lambda d: bpecount.count_tokens(d, BPE),
        "op10": lambda d: simhash.near_duplicates(d),
        "op10 stage": lambda d: simhash.one_of_each(d).select("doc_id", "text"),
    }


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op5 stage", "op6", "op7", "op8", "op9", "op10", "op10 stage"])
def test_clashing_columns_null_ids_and_repeats(spark, name):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(prose(rng, 4)) for _ in range(5)) for _ in range(10)]
    texts = [*texts, *texts[:3], texts[0] + "\n" + texts[1], None, "", " \n \n ", "one"]
    rows = [(i, t, "en" if i % 3 else "de", "src0") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (0, "another text of id 0", None, None), (None, texts[4], "en", "src0"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    run = operators(spark)[name]
    plain = sorted(map(repr, run(d).collect()))
    more = d.withColumns({c: F.lit("x") for c in NAMES if name != "op7" or c not in ("domain", "n_tokens", "epoch")})
    assert sorted(map(repr, run(more.repartition(3)).collect())) == plain
    assert run(more.limit(0)).count() == 0
    if name in ("op4", "op5", "op6", "op8", "op9", "op10"):
        assert len(plain) == len(rows)
