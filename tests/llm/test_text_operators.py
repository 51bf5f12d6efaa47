"""Operators on words, languages, pages and packing, against brute force on small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import chat, decontaminate, langid, licenses, lm, neardup, packing, records
from claimcheck.llm.html import main_text

SCHEMA = "doc_id long, text string, bands string, n_words string, rep string, label string"
A = "one two three four five six seven eight nine ten"


def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", "y", "z", "l") for k, t in rows], SCHEMA)


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- op1 -----------------------------------------------------------------------------------


def contamination(text, items, n=8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low(text))
    hit, got = set(), set()
    for k, t in items:
        ws = word.findall(low(t))
        for j in range(max(1, len(ws) - n + 1)) if ws else ():
            win = ws[j : j + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    got.add(str(k))
    return len(w), len(hit), sorted(got)


def test_decontamination(spark):
    items = [(1, A), (2, "SHORT item"), (10, "two three four five six seven eight nine"), (3, None), (4, "..."), (1, "another text of one item"), (None, "a b c"), (5, "ab ab ab ab ab ab ab ab ab")]
    rows = [(1, f"x {A.upper()}, y"), (2, None), (3, ""), (4, "Short-item short item"), (5, "one two three"), (6, "ab " * 300), (6, "ab " * 300), (7, "é" * 3 + " short\titem " * 3), (8, "w " * 20000 + A), (None, A), (9, "one two three four five six seven eight")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 12):  # one block, and several
        got = decontaminate.contaminated(docs(spark, rows), bench, max_index_words=bound).collect()
        assert len(got) == len(rows)
        for r in got:
            want = contamination(r["text"], [x for x in items if x[0] is not None and x[1]])
            c = r["contamination"]
            assert (c["n_words"], c["n_hit"], c["items"]) == want, r["doc_id"]
            assert sum(s["end"] - s["start"] for s in c["spans"]) == c["n_hit"] and r["n_words"] == "y"
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert sorted(r["doc_id"] or 0 for r in decontaminate.drop_contaminated(docs(spark, rows), bench).select("doc_id").collect()) == [2, 3, 5]


# --- op2 -----------------------------------------------------------------------------------


def classes(rows, k, over=80, under=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and under * both >= over * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    comp = {}
    for i, (key, _) in enumerate(rows):
        comp[root(i)] = min(key, comp.get(root(i), key))
    return {key: (len(sets[i]), comp[root(i)]) for i, (key, _) in enumerate(rows)}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for p in rng.choice(len(w), edits, replace=False):
            w[p] = f"z{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, tile", [(5, 100_000), (2, 500)])
def test_near_duplicates(spark, k, tile):
    rng = np.random.default_rng(5)
    texts = [None, "", "  ", "a", "a", "A", "a b", "b a", " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(3010))]
    for size, edits in ((60, 1), (60, 3), (100, 4), (100, 9), (40, 2)):
        base = " ".join(f"v{x}" for x in rng.integers(0, 10**6, size))
        texts += family(rng, base, 12, edits) + [base, base, base.upper()]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows), shingle=k, tile=tile).collect()}
    want = classes(rows, k)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "q"), (4, "q r s"), (1, "q r s")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows), shingle=2).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True)] * 3 + [(2, 1, False), (4, 1, False), (3, 3, True), (None, None, True)], key=str)
    assert neardup.near_duplicates(docs(spark, []), shingle=2).count() == 0
    kept = neardup.drop_near_duplicates(docs(spark, [(1, "a b"), (2, "a b"), (3, None)]), shingle=2)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_pairs_that_meet_no_smallest_are_found(spark, monkeypatch):
    """With one register to a band most buckets are mixed: the second step does the work, on tiles of any size."""
    monkeypatch.setattr(neardup, "MEMBERS", 3)
    rng = np.random.default_rng(11)
    texts = []
    for size in (60, 60, 80):
        base = " ".join(f"v{x}" for x in rng.integers(0, 10**6, size))
        texts += family(rng, base, 9, 3) + family(rng, base, 9, 12)
    # a chain: each is like the next only
    words = [f"c{x}" for x in range(160)]
    texts += [" ".join(words[4 * i : 4 * i + 90]) for i in range(17)]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    want = {i: c for i, (_, c) in classes(rows, 2).items()}
    for tile in (100_000, 300):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), shingle=2, tile=tile, bands=60, rows=1).collect()}
        assert got == want


def test_a_large_family_is_linear_in_the_shuffle(spark):
    """Of n near copies each text goes out once, beside the smallest one's for every MEMBERS."""
    rng = np.random.default_rng(12)
    base = " ".join(f"v{x}" for x in range(40))
    rows = [(i, t) for i, t in enumerate(family(rng, base, 3000, 1))]
    made = []
    plain = neardup._star_links

    def spied(x, *a):
        made.append(x.count())
        return plain(x, *a)

    neardup._star_links, tiles = spied, neardup._tile_links
    neardup._tile_links = lambda *a: made.append("tiles") or tiles(*a)
    try:
        got = neardup.near_duplicates(docs(spark, rows), shingle=2).collect()
    finally:
        neardup._star_links, neardup._tile_links = plain, tiles
    assert {r["component_id"] for r in got} == {0} and len(made) == 1 and made[0] <= 3000 * 1.2


def test_one_row_of_a_repeated_document_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x y"), (3, None), (None, "a b c"), (None, "a b c"), (4, None), (5, None)]
    got = neardup.drop_near_duplicates(docs(spark, rows), shingle=2)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "a b c"), (3, None), (None, "a b c"), (None, "a b c"), (4, None), (5, None)], key=str)
    clash = spark.createDataFrame([(1, "a b", 7), (2, "a b", 8)], "doc_id long, text string, __id long").withColumnRenamed("__id", "kept")
    assert [tuple(r) for r in neardup.drop_near_duplicates(clash, shingle=2).collect()] == [(1, "a b", 7)]


def test_likelihood_and_registers():
    rng = np.random.default_rng(1)
    for j, reach in ((0.9, True), (0.4, False)):
        common = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        n = int(len(common) * (1 - j) / (2 * j))
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2)]
        k = neardup.registers(np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), np.concatenate(sets), 200)
        assert abs((k[0] == k[1]).mean() - j) < 0.12
        counts = [np.array([(k[0] > k[1]).sum()]), np.array([(k[0] < k[1]).sum()]), np.array([(k[0] == k[1]).sum()])]
        assert neardup.may_reach(*counts, float(len(sets[0])), np.array([float(len(sets[1]))]), 0.66)[0] == reach
        # mergeable: the union's registers are the larger ones
        union = np.unique(np.concatenate(sets))
        assert (neardup.registers(np.array([0, len(union)]), union, 200)[0] == np.maximum(k[0], k[1])).all()


# --- op3 -----------------------------------------------------------------------------------


def wrapped(text, width=74, mark=""):
    import textwrap

    return "\n".join(f"{mark}{x}".rstrip() for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""])


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Foo\n\n" + "\n\n".join((licenses._PERMISSION, licenses._NOTICE, licenses._AS_IS))
    bsd = "Copyright 2020, Foo\n\n" + "\n\n".join((licenses._BSD, licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_NAMES, licenses._BSD_AS_IS))
    gpl = "\n\n".join((licenses._GPL, licenses._GPL_REST, licenses._GPL_COPY))
    apache = "Copyright 2020 Foo Corp.\n\n" + licenses._APACHE + "\n\n" + licenses._APACHE_REST
    rows = [
        (1, "a/LICENSE", wrapped(mit), ["MIT"], None),
        (2, "a/b/c.py", "print", ["MIT"], "a"),
        (3, "x/g.c", "/*\n" + wrapped(gpl, 72, " * ") + "*/\nint main() {}", ["GPL-3.0"], None),
        (4, "x/a.py", wrapped(apache, 76, "# ") + "\nimport os", ["Apache-2.0"], None),
        (5, "z/b.py", "Copyright 2020 Foo Corp. Licensed under the Apache License, Version 2.0. More text follows here, and goes on.", ["Apache-2.0"], None),
        (6, "y/COPYING", wrapped(bsd), ["BSD-3-Clause"], None),
        (7, "y/z/e.c", "", ["BSD-3-Clause"], "y"),
        (8, None, None, [], None),
        (9, "w/no.txt", "a licence is not named here", [], None),
        (None, "n/a.c", "SPDX-License-Identifier: MIT", ["MIT"], None),
        (None, "n/b.c", None, ["MIT"], "n"),
        (11, "k/a", "The MIT License (MIT)", ["MIT"], None),
        (11, "k/b", "Licensed under CC BY 4.0.", ["CC-BY-4.0"], None),
        (11, "k/c", "nothing", ["CC-BY-4.0", "MIT"], "k"),
        (12, "long/x", "word " * 200_000 + "\n\nReleased under the MIT License.\n\n" + "word " * 9, ["MIT"], None),
        (13, "q/LICENSE.txt", "This is not a licence that is known.", [], None),
        (14, "", "no name", [], None),
    ]
    files = spark.createDataFrame([(k, p, t, "x", k) for k, p, t, _, _ in rows], "doc_id long, path string, text string, own string, n_units long")
    got = licenses.licensed(files, keep=("doc_id", "path")).collect()
    assert sorted(((r["doc_id"], r["path"], r["licences"], r["inherited_from"]) for r in got), key=str) == sorted(((k, p, want, up) for k, p, _, want, up in rows), key=str)
    assert {r["path"] for r in got if r["licence_file"]} >= {"a/LICENSE", "y/COPYING", "k/a", "k/b"} and "long/x" not in {r["path"] for r in got if r["licence_file"]}
    assert licenses.licensed(files.limit(0)).count() == 0


def test_cosines_against_plain_python(spark):
    """Every unit recomputed with dictionaries; each template matches itself, near ones score between."""
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts += ["MIT License, as is", "see the GNU General Public License, please", "Licensed under the licence of the house", "permission"] + ["plain words"] * 40
    n, df = len(texts), Counter(w for t in texts for w in licenses.template_words(t))
    idf = licenses.Weights(licenses.TEMPLATES, n, df)

    def plain(text):
        out = []
        for unit in {0: re.split(licenses.STOP, text) if re.search(licenses.STOP, text) else [], 2: [text]}.values():
            for u in unit:
                if any(m in u.lower() for m in licenses.MARKS):
                    v = {w: c * idf.idf.get(w, idf.outside) for w, c in licenses.template_words(u).items()}
                    norm = sum(x * x for x in v.values()) ** 0.5
                    out.append(max(sum(x * t.get(w, 0.0) for w, x in v.items()) / norm for _, t in idf.vectors) if v else 0)
        return [round(c, 9) for c in out if c >= 0.75]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("path", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in licenses.licensed(df).collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        assert got[k]["n_units"] == len(want) and abs(got[k]["best_cosine"] - max(want, default=0)) < 1e-8, t
    assert all(got[k]["best_cosine"] == 1 for k in range(len(texts) - 44))


# --- op5 -----------------------------------------------------------------------------------


def plain_tokenizer(name):
    """The library's own, with no setting changed."""
    from tokenizers import Tokenizer

    from claimcheck.llm.bpe import tokenizer_path

    return Tokenizer.from_file(tokenizer_path(name))


def test_records_round_trip(spark, tmp_path):
    rows = [(5, "hello world"), (-3, None), (7, ""), (1, "line\nfeeds\n\n and   spaces"), (1, "a repeated id"), (None, "no id"), (9, "long " * 20_000), (2, "<|endoftext|>"), (3, "a<|endoftext|>b")]
    rows += [(100 + k, f"document {k} of many " * (k % 7)) for k in range(300)]
    df = docs(spark, rows)
    path = f"file://{tmp_path}/r"
    index = records.write_dataset(df, path, tokenizer="byte_bpe_50k.json", end_id=2, file_bytes=20_000).orderBy("start").collect()
    tk = plain_tokenizer("byte_bpe_50k.json")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in order]
    start = 0
    for r, (key, _), x in zip(index, order, ids):
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert len(index) == len(rows) and len({r["file"] for r in index}) > 2
    # many readers in one file find each frame once
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, "997")
    try:
        read = records.read_records(spark, path, columns="ids")
        assert read.rdd.getNumPartitions() > 20
        back = {(r["file"], r["offset"]): r["ids"] for r in read.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(back) == len(rows) and all(back[r["file"], r["offset"]] == x.tobytes() for r, x in zip(index, ids))
    # the same by lengths alone, from the raw bytes of a file
    marker = next((tmp_path / "r" / "marker").glob("part-*")).read_text().strip()
    for file in (tmp_path / "r" / "frames").glob("part-*"):
        number = int(file.name.split("-")[1])
        got = {at: records.opened(held)[1] for at, held in records.frames(file.read_bytes(), marker)}
        assert got == {at: raw for (n, at), raw in back.items() if n == number}
    assert records.write_dataset(df.limit(0), f"{path}0", tokenizer="byte_bpe_50k.json", end_id=2).count() == 0


def test_damaged_records_are_found():
    mark = "0123456789abcdef" * 2
    one = records.frame(b"payload", 0) + mark.encode()
    good = one + records.frame(b"payload", len(one)) + mark.encode()
    assert [bytes(p) for _, p in records.frames(good, mark)] == [b"payload"] * 2
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad), mark))
    with pytest.raises(ValueError):
        list(records.frames(good[:-3], mark))


def test_pieces_encode_as_whole_texts():
    import pyarrow as pa

    from claimcheck.llm.bpe import Encoder

    rng = np.random.default_rng(2)
    alphabet = list("ab é,.'’—\n\t  　\x1c!ß1２3É×'s\r  ") + ["<|endoftext|>", "the", "'re"]
    texts = ["", "\n\n a"] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(name, 2)
        offsets, ids = e(pa.array(texts))
        for i, x in enumerate(plain_tokenizer(name).encode_batch(texts, add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == x.ids + [2]


def test_joined_pieces_and_a_small_cache_change_no_id(monkeypatch):
    import pyarrow as pa

    from claimcheck.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    rng = np.random.default_rng(3)
    letters = list("abcdefgéßÿ") + ["\u01c4", "\u0130", "e\u0301", "\u0926"]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 60)) + "." for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, plain = bpe.Encoder(name, 7), plain_tokenizer(name)
        for a in range(0, len(texts), 50):
            offsets, ids = e(pa.array(texts[a : a + 50]))
            assert len(e.young) < 120
            for i, x in enumerate(texts[a : a + 50]):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(x, add_special_tokens=False).ids + [7]


# --- op6 -----------------------------------------------------------------------------------

WORDS = {"en": "the and of with that house water morning reading", "de": "der und nicht mit straße häuser schön wasser morgen", "fr": "le et de avec maison été garçon matin lire", "es": "el y de con casa niño mañana leer agua"}


def test_language_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[k].split(), 30)), k) for i, k in enumerate(list(WORDS) * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train.union(spark.createDataFrame([(900, None, "en"), (901, "x", None)], train.schema)), sample_rows=120)
    assert model.languages == sorted(WORDS) and model.code.shape == (4, 7)
    test = [(1, "the house and the water"), (2, None), (3, ""), (4, "123 !!"), (5, "DER UND NICHT"), (6, "le garçon " * 30_000), (6, "le garçon"), (None, "el niño")]
    got = langid.predicted(docs(spark, test), model, into="label").select("doc_id", "label", "rep").collect()
    assert [r["label"]["lang"] for r in got] == ["en", "und", "und", "und", "de", "fr", "fr", "es"] and all(0 <= r["label"]["score"] <= 1 for r in got)
    assert langid.predicted(docs(spark, []), model).count() == 0
    nothing = langid.train(train.limit(0))
    assert {r["language"]["lang"] for r in langid.predicted(docs(spark, test), nothing).collect()} == {"und"}
    one = langid.train(train.where("lang = 'en'"))
    assert {r["language"]["lang"] for r in langid.predicted(docs(spark, test[:1]), one).collect()} == {"en"}


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS["en" if i % 400 else "de"].split(), 12)), "en" if i % 400 else "de") for i in range(1200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=40)
    assert model.languages == ["de", "en"]
    got = langid.predicted(docs(spark, [(1, "der und nicht mit wasser"), (2, "the house and the water")]), model).select("doc_id", "language.lang").collect()
    assert dict(map(tuple, got)) == {1: "de", 2: "en"}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 12):
        c = langid.codewords(n)
        assert min(((c[i] != c[j]).sum() for i in range(n) for j in range(i))) >= max(1, c.shape[1] // 3)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = langid.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


# --- op7 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, n).astype(int) + 1, 2048)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    intervals, bins = packing.plan(histogram)
    fill, ranks = {}, {}
    for length, a, z, first, offset in intervals:
        ranks.setdefault(length, []).extend(range(a, z))
        for r in range(a, z):
            fill.setdefault(first + r - a, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in histogram.items()}
    assert sorted(fill) == list(range(bins))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert bins <= -(-lengths.sum() // 2048) * 1.01 + 1


def test_packing(spark):
    rows = [(1, "word " * 3000), (2, None), (3, ""), (4, "short text"), (4, "short text"), (None, "no id"), *((100 + k, "some words " * k) for k in range(1, 60))]
    got = packing.packed(docs(spark, rows), tokenizer="word_bpe_49k.json", end_id=0).collect()
    tk = plain_tokenizer("word_bpe_49k.json")
    want = []
    for key, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(key, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs(spark, []), tokenizer="word_bpe_49k.json", end_id=0).count() == 0


# --- op8 -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- x --><div class="cookie-banner">We use cookies, all of them.</div><div class="ad">Buy, now.</div><article><h1>Title &amp; more</h1><p><b>Bold  line.
<br><p>Second &eacute; para,\n with lines.</p><ul><li>one<li>two</ul><p>Short.</p><form><label>Mail</label></form><div class="comments"><p>A reader says, at length, that this is fine.</p></div></article><aside>Related</aside><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "page, want",
    [
        (PAGE, "Title & more\nBold line.\nSecond é para, with lines.\none\ntwo\nShort."),
        ("", ""),
        (None, ""),
        ("just text &lt;b&gt;", "just text <b>"),
        ("<nav>only menu</nav>", ""),
        ('<body><div class="menu"><a>x</a></div><div id=c><h1>T</h1><p>Long text here, with commas, and stops. More.</p><p>Short.</p></div><div class=footer>f</div>', "T\nLong text here, with commas, and stops. More.\nShort."),
        ("<article><p>a<script>x</script> b<!-- c --> d</p></article>", "a b d"),
        ("<article>" + "<p>x</p>" * 20000 + "</article>", "\n".join("x" * 20000)),
        ("<article><p>unclosed <b>bold <i>deep", "unclosed bold deep"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_all_containers_with_passing_paths_are_kept():
    story = "".join(f"<p>Sentence {i} of the story, which goes on, and on, for a while.</p>" for i in range(200))
    lead = "<p>The lead, in one paragraph, says what happened, to whom, and when.</p>"
    got = main_text(f"<body><div class=content><div class=lead>{lead}</div><div class=story>{story}</div><div class=facts><ul><li>one<li>two</ul></div></div>")
    assert got.startswith("The lead,") and got.endswith("one\ntwo") and got.count("Sentence") == 200
    two = main_text(f"<body><article>{story}</article><article>{lead}</article><div><p>Outside, of both.</p></div>")
    assert two.endswith("and when.") and two.count("Sentence") == 200


def test_noise_words_in_content():
    kept = ['<h2 id="related-work">', '<h2 id="search-results">', '<h2 id="form-and-function">', '<section id="discussion">', '<div class="article-header">', '<div class="search-theory">', '<p id="share-of-votes">']
    for tag in kept:
        name = tag[1:].split()[0]
        assert main_text(f"<article><h1>T</h1>{tag}Kept words.</{name}><p>More.</p></article>") == "T\nKept words.\nMore.", tag
    for tag in ('<div class="comments">', '<div class="comment-list">', '<div class="related-posts x">', '<div id="newsletter-signup">', '<section id="comments">', '<div role="search">', '<section class="ad">'):
        name = tag[1:].split()[0]
        assert main_text(f"<article><h1>T</h1>{tag}Dropped words.</{name}><p>More.</p></article>") == "T\nMore.", tag
    assert main_text('<div><h2 id="related-work">Related work</h2><p>Long, and longer.</p></div><div class="page-footer">f</div>') == "Related work\nLong, and longer."


def test_broken_pages_take_linear_time():
    import time

    t = time.perf_counter()
    for x in ("<a ", "<a href='", '<a href="', "<!--", "<", "<p", "</", "<a b='\"", "<div>", "&amp", "<script>"):
        main_text("text " + x * 20_000)
    assert time.perf_counter() - t < 20


def test_article_text_under_listed_words_stays():
    body = "".join(f"<p>Sentence {i} of the story, which goes on, and on, for a while.</p>" for i in range(10))
    for page, part in (
        (f'<body><div class="post"><div class="post-header"><h1>Headline</h1></div>{body}</div></body>', "Headline\nSentence 0"),
        (f'<article><h1>H</h1>{body}<section class="discussion"><p>We discuss.</p></section></article>', "while.\nWe discuss."),
        (f'<body><div id=c><div class="side-by-side"><p>One, two.</p></div>{body}</div>', "One, two.\nSentence 0"),
        (f'<article>{body}<p class="form">Form, of things.</p></article>', "while.\nForm, of things."),
        (f"<article>{body}<p>as <math><mi>x</mi><mo>=</mo></math> is</p></article>", "as x= is"),
        (f'<div class="widget">{body}</div><div class="sidebar">links</div>', "Sentence 0"),
    ):
        got = main_text(page)
        assert part in got and got.count("Sentence") == 10, page
    comments = f'<body><article>{body}<div class="comments">{body * 3}</div></article><div class="comments-area"><p>x, y.</p></div>'
    assert main_text(comments).count("Sentence") == 10


def test_path_ratios_by_brute_force():
    from claimcheck.llm import html

    page = html.read("<body><nav><a>x</a></nav><div class=a><p>One, two.</p><p>Three.</p><ul><li>four<li>five, six</ul></div><div class=b><p>Seven; eight.</p><h2>Nine</h2></div><p>Ten")
    at = {n: k for k, n in enumerate(page.name)}

    def path(node):
        out = []
        while node:
            out.append((page.name[node], page.path[node]))
            node = page.parent[node]
        return tuple(reversed(out))

    names = [tuple(n for n, _ in path(node)) for node, _ in page.blocks]
    assert [t for _, t in page.blocks] == ["One, two.", "Three.", "four", "five, six", "Seven; eight.", "Nine", "Ten"] and at["li"]
    own = [page.path[node] for node, _ in page.blocks]
    assert own[0] == own[1] != own[4] and names[0] == names[4] == ("body", "div", "p")  # classes are part of a path
    ratio, marks = [], []
    for p in own:
        texts = [t for (_, t), q in zip(page.blocks, own) if q == p]
        ratio.append(sum(map(len, texts)) / len(texts))
        marks.append(sum(c in ".,;:!?" for t in texts for c in t) / len(texts))
    want = []
    for i in range(len(own)):
        near = [(w, j) for w, j in zip((1, 2, 4, 2, 1), range(i - 2, i + 3)) if 0 <= j < len(own)]
        mean = lambda x: sum(w * x[j] for w, j in near) / sum(w for w, _ in near)
        want.append(mean(ratio) * (1 + mean(marks)))
    assert np.allclose(html.path_scores(own, [t for _, t in page.blocks]), want)


def test_deep_pages_take_linear_time():
    import time

    t = time.perf_counter()
    for x in ("<div>x. ", "<b>x ", "<p>a", "<ul><li>a, b", "<table><tr><td>x"):
        main_text(x * 20_000)
    main_text("<div>" * 20_000 + "x</p></i>" * 20_000)
    assert time.perf_counter() - t < 10


def test_extraction(spark):
    from claimcheck.llm.html import extracted

    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = extracted(df).collect()
    assert [r["text"] for r in got] == [main_text(PAGE)] * 2 + [""] and extracted(df).columns == ["page_id", "url", "text"] and extracted(df.limit(0)).count() == 0


# --- op9 -----------------------------------------------------------------------------------


class PlainBackoff:
    """The model of the docstring, by dictionaries and recursion."""

    def __init__(self, texts):
        self.n, self.letter = Counter(), Counter()
        for t in texts:
            w = ["<start>", *t, None]
            for k in (1, 2, 3):
                self.n.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            for x in t:
                b = [-1, *x.encode(), -2]
                for k in (1, 2, 3, 4):
                    self.letter.update(tuple(b[i : i + k]) for i in range(len(b) - k + 1))
        single = {k[0]: c for k, c in self.n.items() if len(k) == 1 and k[0] != "<start>"}
        self.size = sum(single.values())
        self.unknown = min(0.5, max(1, sum(c == 1 for c in single.values())) / self.size) if self.size else 0.5
        self.letters = sum(c for k, c in self.letter.items() if len(k) == 1 and k != (-1,))

    def spelled(self, history, x):
        if not history:
            return (self.letter[(x,)] + 0.5) / (self.letters + 0.5 * 257)
        return (self.letter[(*history, x)] + 4 * self.spelled(history[1:], x)) / (self.letter[history] + 4)

    def word(self, history, w):
        if not history:
            if self.n[(w,)]:
                return (1 - self.unknown) * self.n[(w,)] / self.size
            if w is None:
                return 0.5
            b = [-1, *w.encode(), -2]
            return self.unknown * np.prod([self.spelled(tuple(b[max(0, i - 3) : i]), b[i]) for i in range(1, len(b))])
        prior = lm.PRIOR[len(history) - 1]
        return (self.n[(*history, w)] + prior * self.word(history[1:], w)) / (self.n[history] + prior)

    def score(self, text):
        w = ["<start>", *text, None]
        return sum(np.log10(self.word(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w)))


def test_lm_scoring(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("th", "er", "on", "é") for b in ("an", "tion", "ble", "")]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "Unseen wörds\x0bx"), (203, "w" * 60), (204, "the " * 5_000 + "er "), (None, "on"), (5, "er")]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    words = {id(r): re.findall(r"[^\x20\x09-\x0D]+", low(r[1])) + [None] for r in rows}
    c = Counter(w for r in rows if r[0] is not None and not held(r[0]) for w in words[id(r)])
    plain = PlainBackoff([words[id(r)][:-1] for r in rows if r[0] is not None and not held(r[0])])
    n, v = sum(c.values()), len(c)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    want = {}
    for r in rows:
        w = words[id(r)]
        want.setdefault(r[0], []).append((len(w), sum(c[x] > 0 for x in w), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), plain.score(w[:-1])))
    for block in (1 << 26, 2_000):  # one block a task, and many
        got = lm.scored(docs(spark, rows), train, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            near = lambda a, b: abs(a - b) < 1e-9 * max(1, abs(b))
            assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3] and near(r["base_score"], x[3]) and near(r["score"], x[4]) for x in want[r["doc_id"]]), (r, want[r["doc_id"]])
    assert lm.scored(docs(spark, []), train).count() == 0
    unseen = {r["doc_id"]: r for r in lm.scored(docs(spark, rows[:3]), F.lit(False)).collect()}
    none = PlainBackoff([])
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["score"] - none.score(words[id(rows[k])][:-1])) < 1e-6 for k, r in unseen.items())
    one = lm.scored(spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, train long"), F.lit(True)).collect()
    assert len(one) == 1 and one[0]["n_known"] == 2


def test_order_of_words_counts_and_the_model_beats_the_base(spark):
    rng = np.random.default_rng(8)
    follow = {k: rng.choice(60, 4) for k in range(60)}
    rows = []
    for i in range(400):
        w = [int(rng.integers(60))]
        while len(w) < 40:
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    rows.append((1000, " ".join(reversed(rows[0][1].split()))))
    got = {r["doc_id"]: r for r in lm.scored(docs(spark, rows), F.col("doc_id") < 300).collect()}
    assert got[1000]["score"] < got[0]["score"] - 10 and abs(got[1000]["base_score"] - got[0]["base_score"]) < 1e-9
    held = [r for k, r in got.items() if 300 <= k < 1000]
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held)


def test_the_model_is_a_distribution_and_texts_may_be_entered_anywhere(monkeypatch):
    """Over known words, the end and what unknown words get; the automaton against plain backoff on segments of any size."""
    rng = np.random.default_rng(6)
    texts = [[f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 40))] for _ in range(60)]
    words = sorted({w for t in texts for w in t})
    plain = PlainBackoff(texts)
    for history in [(), ("<start>",), ("w1",), ("<start>", "w2"), ("w3", "w4"), ("unseen", "w1")]:
        assert abs(sum(plain.word(history, w) for w in [*words, None]) + plain.unknown * np.prod([lm.PRIOR[k] / (plain.n[history[-k - 1 :]] + lm.PRIOR[k]) for k in range(len(history))]) - 1) < 1e-9
    import zstandard

    codes = np.array([words.index(w) for t in texts for w in t], "<u4")
    block = lm.Block.of(lm.packed(codes), zstandard.ZstdCompressor().compress("\n".join(words).encode()), [len(t) for t in texts], [True] * len(texts))
    found = block.word_levels(3, 54)
    totals = {"tokens": plain.size, "ends": len(texts), "letters": plain.letters, "once": sum(c == 1 for k, c in plain.n.items() if len(k) == 1 and k != ("<start>",))}
    spelled = block.letter_levels(4, np.zeros(len(words)))
    for segment in (3, 7, 256):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        _, _, score = lm.text_scores(block, found, [x.counts.astype(float) for x in found], spelled, [np.zeros(len(x.keys)) for x in spelled[2]], totals)
        assert np.allclose(score, [plain.score(t) for t in texts], atol=1e-9)


# --- op10 ----------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 2, "assistant", "B\\l <|im_end|>\n"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 3, "assistant", "again<"), (2, 1, "assistant", None), (2, 1, "assistant", ""), (3, None, "odd\nrole<|", "x"), (3, 1, None, "|<|turn|>"), (None, 1, "user", "<<SYS>>\\e\\"), (4, 1, "assistant", "ab" * 100_000)] + [(5, k, "assistant", f"t{k}") for k in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = chat.format_conversations(df).withColumn("back", chat.parsed(F.col("formatted"))).withColumn("loss", chat.learned(F.col("segments"))).collect()
    assert len(got) == 6
    for r in got:
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["back"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    one = next(r for r in got if r["conv_id"] == 1)["formatted"]
    assert one.count("<|im_start|>") == 2 and one.count("<|turn|>") == 1 and "[INST]" not in one and "</s>" not in one
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert "Python" not in chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
