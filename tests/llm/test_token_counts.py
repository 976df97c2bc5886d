import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from millrace.llm import token_counts as tc
from tests.llm.odd import TEXTS, docs

UNKNOWN = "\U0010ffff"


def tokenizer(vocabulary):
    made = Tokenizer(models.Unigram([(UNKNOWN, 0.0), *vocabulary.pieces], unk_id=0, byte_fallback=True))
    made.normalizer = normalizers.Sequence([normalizers.Prepend(tc.MARK), normalizers.Replace(" ", tc.MARK)])
    return made


@pytest.fixture(scope="module")
def vocabulary():
    return tc.read_vocabulary()


def test_counts_are_those_of_the_tokenizer(vocabulary):
    texts = [t for (t,) in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += ["", " ", "  a  b ", "\n", "\n\na \n b", "☃☃ x☃y <0x0A>", "a▁b ▁", "日本語テキスト", "\r\n\t x", TEXTS[8][1]]
    exact, own = tokenizer(vocabulary), tc.Counter(vocabulary)
    assert [own.of_text(t) for t in texts] == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]


BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
SMALL = [("▁", -3.0), ("a", -4.0), ("b", -4.0), ("ab", -8.0), ("ba", -8.0), ("aba", -12.0), ("▁a", -7.0), ("▁ab", -9.0), ("bb", -2.0), ("▁▁", -6.0)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é☃\n", max_size=24), st.booleans())
def test_ties_and_pieces_across_words(text, across):
    vocabulary = tc.Vocabulary(SMALL + BYTES + ([("a▁b", -10.0), ("b\na", -9.0), ("\n", -1.0)] if across else []))
    assert tc.Counter(vocabulary).of_text(text) == len(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids)


def test_long_words_are_not_remembered(vocabulary):
    exact, own = tokenizer(vocabulary), tc.Counter(vocabulary)
    texts = [f"{k}" + "abc☃日本" * 400 + f" short {'y' * tc.LONGEST} {'y' * (tc.LONGEST - 1)}" for k in range(30)]
    assert [own.of_text(t) for t in texts] == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    assert set(own) == {tc.MARK + "short", tc.MARK + "y" * (tc.LONGEST - 1)}


def test_odd_rows(spark):
    got = tc.token_counts(docs(spark))
    assert got.columns == ["doc_id", "n_tokens"] and got.count() == len(TEXTS)
    assert {r.n_tokens for r in got.where("doc_id in (1, 2)").collect()} == {0}
    assert tc.token_counts(docs(spark, [])).count() == 0
