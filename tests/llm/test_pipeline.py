import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_jaccard import brute as classes
from test_line_dedup import brute as lines
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """Documents with nulls in every column, empty and repeated rows, copies, near copies and a benchmark item."""
    from descra.llm import kit

    docs = [tuple(r) for r in kit.read(spark, SF, "documents").orderBy("doc_id").limit(100).collect()]
    item = kit.read(spark, SF, "benchmark").where("length(text) > 100").orderBy("item_id").first().text
    words = " ".join(f"w{i}" for i in range(60))
    extra = [None, "", " \n", "one", words, words.replace("w30", "x"), words, item, f"before {item} after", "a b c"]
    docs += [(9000 + i, t, None, None, None) for i, t in enumerate(extra)]
    docs += [(None, "no id here at all", "en", "s", 17), (None, None, None, None, None), docs[5], docs[5], (9004, "another text of the same id", "en", "s", 3)]
    return spark.createDataFrame(docs, COLUMNS).repartition(3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage_against_brute_force(spark):
    import corpus_pipeline
    from descra.llm import kit, tokens, toxicity

    rows = lambda df: [tuple(r) for r in df.collect()]
    stages, docs = dict(corpus_pipeline.STAGES), kit.written(documents(spark), "documents")
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]

    def step(name, df):
        out = kit.written(stages[name](spark, df, SF), name)
        assert name == "packing" or out.columns == df.columns
        return out

    # Toxicity: what the score says, whatever a row's other columns; empty texts are clean.
    labels = kit.read(spark, SF, "labels")
    score = toxicity.with_scores(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    bad = Counter((r.doc_id, r.text) for r in score.where("toxicity >= 0.5").collect())
    clean = step("toxicity", docs)
    assert Counter(rows(clean)) == Counter(r for r in rows(docs) if (r[0], r[1]) not in bad)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert not any(r[0] not in toxic for r in rows(docs) if (r[0], r[1]) in bad)

    single = step("line_dedup", clean)
    assert sorted(((r[0], r[1]) for r in rows(single)), key=str) == lines([(r[0], r[1]) for r in rows(clean)])

    apart = step("jaccard_join", single)
    component = {d: c for (d, _, c) in classes([(r[0], r[1]) for r in rows(single)], 5, 80)}
    assert Counter(rows(apart)) == Counter(r for r in rows(single) if r[0] is None or component[r[0]] == r[0])

    kept = step("decontamination", apart)
    items = [(r.item_id, r.text) for r in kit.read(spark, SF, "benchmark").collect()]
    gone = Counter({d: n for (d, *_, bad), n in hits([(r[0], r[1]) for r in rows(apart)], items, 13).items() if bad})
    assert Counter(r[0] for r in rows(apart)) - Counter(r[0] for r in rows(kept)) == gone and gone

    packed = step("packing", kept).collect()
    library = Tokenizer.from_file(tokens.vocabulary_path())
    place, pieces = defaultdict(list), defaultdict(list)
    for r in packed:
        assert len(r.ids) == 4 * r.length <= 4 * 2048
        place[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for some in place.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    left = rows(kept)
    for r in left:
        if sum(x[0] == r[0] for x in left) == 1:
            own = sorted(pieces[r[0]], key=lambda p: p.piece)
            assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_on_empty_tables(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark).limit(0), SF).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_columns_with_clashing_names(spark):
    import corpus_pipeline

    names = ["report", "toxicity", "set_id", "salt", "hash", "chunk", "key", "prefix", "component_id"]
    docs = documents(spark).where("doc_id < 40 or doc_id is null").withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == out.count() > 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_leaves_its_last_table_alone(spark):
    import corpus_pipeline
    from descra.llm import kit

    with kit.recorded() as made:
        out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in kit.read(spark, SF, "documents").collect()}
    left = []
    for path in made:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        left += [path] * p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    assert left == made[-1:]


def test_every_query_is_registered():
    import __spark_entry__

    assert len([n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]) == 11
