import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    from ternlens.llm.queries import vocabulary_path
    return vocabulary_path()


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: Nulls, empty and white texts, a long one, ties, copies, repeated rows and a row without an identifier.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t", "en", "a", 3),
    (4, "12 34 !!", None, "a", 8),
    (5, "the cat sat on the mat and the dog ran to the barn with a hat on it", "en", "a", 3),
    (6, "the cat sat on the mat and the dog ran to the barn  with a hat on it", "en", "b", 3),
    (7, "the cat sat on the mat and the dog ran to the barn with a hat on it", "en", "b", 3),
    (8, "der hund lief durch den wald und die katze saß auf dem dach", "de", "b", 3),
    (8, "der hund lief durch den wald und die katze saß auf dem dach", "de", "b", 3),
    (9, "one two", "en", "b", 7),
    (10, "x" * 70_000 + " end", "en", "b", 70_004),
    (None, "a row without an identifier", "en", "c", 1),
    (11, "<|endoftext|> in a text, 日本語 and 😀", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(c) for c in ("id", "n", "y", "h", "key", "rep", "label", "sha", "salt", "k1", "score", "x", "dim", "term")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
