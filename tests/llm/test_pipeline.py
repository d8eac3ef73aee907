"""Each stage of the corpus pipeline, and the whole of it, against plain Python on a small table with nulls, repeats, long texts and clashing columns."""

import random
import shutil
from collections import Counter, defaultdict

import pytest
import zstandard as zstd
from siftwell.llm import langid
from tests.llm import test_operators as plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: The columns of documents, and others that clash with names of the operators.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, lang_pred string, __hash string, __id int, __lines int, __n_lines2 int, g_id int, g_hash int, row int, k_id int, root int, kept int, length int"
OURS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {"aa": ["alba", "berti", "corno", "dolce", "ente", "fumo", "gatto", "isola"], "bb": ["kratz", "schlok", "wümpf", "zorb", "quint", "plötz", "grund", "haus"]}


def text_of(seed, lang, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "a", "en", "i"]) for _ in range(n))


def table():
    texts = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        texts.append((text_of(i, lang, 60 + i), lang if i % 5 else None))
    near = texts[10][0].split()
    near[30] = "changed"
    texts += [(texts[10][0], "bb"), (" ".join(near), "bb"), (None, "aa"), ("", "aa"), ("123 456 !!", None), (text_of(900, "aa", 6000), "aa")]
    passage = "\n".join(text_of(300 + i, "aa", 6) for i in range(4))
    texts += [(text_of(400 + i, "aa", 40) + "\n" + passage + "\n" + text_of(500 + i, "aa", 30), "aa") for i in range(4)]
    texts += [(passage, "aa"), (text_of(700, "bb", 30) + " " + text_of(800, "bb", 14) + " " + text_of(701, "bb", 30), "bb"), ("one", "aa"), ("alba", None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return rows + [rows[3], rows[10], (None, text_of(990, "aa", 50), None, None, 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("pipeline"))
    extra = [0.5, "x", "x", "x", *[1] * 10]
    spark.createDataFrame([(*r, *extra) for r in table()], COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    items = [(1, text_of(800, "bb", 14)), (2, None), (3, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    yield where
    shutil.rmtree(where, ignore_errors=True)


def rows_of(df):
    return Counter(tuple(r[c] for c in OURS) for r in df.collect())


def plain_language(rows, dictionaries, level=6, block=8192, margin=0.002):
    """Sizes by one-shot compression with each dictionary."""
    out = []
    for r in rows:
        if r[1] is None or not langid.LETTER.search(r[1]):
            continue
        raw = langid.plain(r[1])
        sizes = {}
        for lang, d in dictionaries.items():
            c = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[i : i + block])) for i in range(0, len(raw), block))
        best, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        if 1 - best[0] / second[0] >= margin:
            out.append((*r[:2], r[2] if r[2] is not None else best[1], *r[3:]))
    return out


def plain_lines(rows):
    kept = {(d, t): (new, n) for (d, new, n), t in zip_lines(rows)}
    out = []
    for d, t, lang, source, n in rows:
        new, gone = kept[d, t]
        if not gone or new:
            out.append((d, new, lang, source, len(new) if gone else n))
    return out


def zip_lines(rows):
    first = {}
    for none, d, t in sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}):
        w = t.split("\n")
        for i in range(len(w) - 1):
            first.setdefault((w[i], w[i + 1]), (none, d, t, i))
    for d, t, *_ in rows:
        w = (t or "").split("\n")
        gone = {i + j for i in range(len(w) - 1) if first[w[i], w[i + 1]] != (d is None, d or 0, t, i) for j in (0, 1)}
        yield (d, "\n".join(x for i, x in enumerate(w) if i not in gone) if gone else t, len(gone)), t


def plain_jaccard(rows):
    sets = [s for _, s in plain.shingle_sets([r[:2] for r in rows])]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i] if sets[i] else -1 - i].append(r)
    # of a group's rows with the smallest id the text hash decides; here such rows are equal
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_clean(rows, items):
    hits = plain.reference_hits([r[:2] for r in rows], items)
    bad = {k[0] for k in hits if k[5]}
    return [r for r in rows if r[0] not in bad]


def test_each_stage_and_the_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    dictionaries = langid.learn_dictionaries(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    wants = [lambda rows: plain_language(rows, dictionaries), plain_lines, plain_jaccard, lambda rows: plain_clean(rows, items)]
    rows = [tuple(r[c] for c in OURS) for r in docs.collect()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = want(rows)
        assert rows_of(out) == Counter(kept), name
        assert len(kept) < len(rows) or name == "line dedup" and kept != rows, name
        rows = kept
        docs = corpus_pipeline.materialise(out, "test")
    packed = corpus_pipeline.packing(spark, docs, folder).collect()
    pieces = plain.reference_pieces([r[:2] for r in rows], 1024)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == pieces


def test_stages_of_nothing(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_columns_named_as_the_counts_give_way(spark):
    from siftwell.llm import linededup, quality, secrets

    docs = spark.createDataFrame([(1, "a\nb", 7, 7.0, 7)], "doc_id long, text string, __n_lines int, score double, n_hex int")
    assert linededup.dedup_lines(docs).columns == ["doc_id", "text", "score", "n_hex", "__n_lines", "__n_removed"]
    ranking = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, ranking, ["doc_id", "score"]).columns == ["doc_id", "score"]
    assert langid.identify(docs, {}, ["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score", "rejected"]
    assert secrets.scan(docs, ["doc_id", "n_hex"]).columns == ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "all_spans"]


def test_long_texts_teach_their_language_too(spark):
    rows = [(i, text_of(i, "aa" if i % 2 else "bb", 5000), "aa" if i % 2 else "bb") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(map(lambda r: len(r[1]), rows)) > 20_000
    dictionaries = langid.learn_dictionaries(docs)
    assert sorted(dictionaries) == ["aa", "bb"]
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, dictionaries, ["doc_id"]).collect()} == {i: lang for i, _, lang in rows}


def test_registered_pipeline():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
