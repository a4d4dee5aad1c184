"""Documents that every operator meets: nulls, empty and very long texts, repeated rows, clashing names."""

import pytest
from helpers import DOCS, LONG, prose
from pyspark.sql import functions as F

from kindred.llm import queries


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "  \n\t", "one two", prose(80, 1), prose(80, 1), prose(80, 2) + "\n" + prose(80, 1), LONG, "x y z " * 40, "a | b | c | d | e\n" * 30, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(70, 3)]
    rows = [(i, t, "en", None if i % 4 == 3 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("kept", "n_words", "fp", "component_id", "size", "spans", "part", "node", "__row", "key")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t
