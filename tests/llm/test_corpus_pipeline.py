from __future__ import annotations

import hashlib
import re
from pathlib import Path

import corpus_pipeline
import pyarrow.parquet as pq
import sentencepiece
from conftest import SMALL
from pyspark.sql import Row
from test_budgets import plain_mix
from test_covering import plain_components
from test_surrogates import ANY

from agorametric.llm import weak_quality as wq
from agorametric.llm.common import prepare, stored, table
from agorametric.llm.queries import MIX_WEIGHTS, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(frame):
    return {row["doc_id"]: row.asDict() for row in frame.collect()}


def test_every_stage_and_the_whole(spark):
    docs = table(prepare(spark), SMALL, "documents")
    steps, names = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SMALL), "step"))
        names.append(name)
    assert [re.split(r"\W", name)[0] for name in names] == ["quality", "SimHash", "PII", "mixing", "SentencePiece"]
    assert all(step.columns == COLUMNS for step in steps[:-1])
    start, good, unique, private, chosen, encoded = map(rows_of, steps)

    model = wq.fit(docs)
    assert set(good) == {row["doc_id"] for row in wq.score(docs, model).where("is_kept").collect()}
    labels = pq.read_table(Path(SMALL) / "labels.parquet").to_pylist()
    assert all(row["doc_id"] in good for row in labels if row["quality"])
    assert sum(row["doc_id"] not in good for row in labels if not row["quality"]) > 0
    assert all(good[id] == start[id] for id in good)

    groups = plain_components([(id, row["text"]) for id, row in good.items()])
    assert set(unique) == {group for _, _, group in groups} and len(unique) < len(good)
    assert all(unique[id] == start[id] for id in unique)

    assert private.keys() == unique.keys()
    for id, row in private.items():
        old = unique[id]["text"]
        assert ANY.split(old) == ANY.split(row["text"]) and row["n_chars"] == len(row["text"])
        assert not set(ANY.findall(old)) & set(ANY.findall(row["text"]))

    domain = {"src0": "web"} | {f"src{at}": "books" for at in range(1, 10)}
    leaf = [
        (id, row["text"], (domain.get(row["source"], "notes"), row["lang"], row["source"]), (len(row["text"]) + 3) // 4)
        for id, row in private.items()
    ]
    budget = int(sum(row[3] for row in leaf) * corpus_pipeline.MIX_SHARE)
    exact = {leaf[at][0] for at, _ in plain_mix(leaf, ["domain", "lang", "source"], MIX_WEIGHTS, budget, 1, 0)}
    assert set(chosen) == exact and all(chosen[id] == private[id] for id in chosen)

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert encoded.keys() == chosen.keys()
    for id, row in encoded.items():
        ids = library.encode(chosen[id]["text"], add_eos=True)
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(library.decode(ids))

    assert rows_of(corpus_pipeline.run(spark, SMALL)) == encoded


def test_odd_rows_pass_every_stage(spark):
    text = "A plain text of words that says what it is. It goes on for a while."
    rows = [
        Row(1, None, None, None, None),
        Row(2, "", "en", "src1", 0),
        Row(3, text, None, None, None),
        Row(3, text, None, None, None),
        Row(None, text, "en", "src1", 1),
        Row(4, f"{text} " * 5000, "en", "src0", 7),
    ]
    prepare(spark)
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), "odd")
        docs.collect()
