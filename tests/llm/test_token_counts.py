import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings, strategies as st

from tablelens.llm import token_counts as K

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(K.MODEL))
ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "▁", "▁▁a ▁b", "a▁ b", "<s> </s> <unk>", "\n", "a\nb \n c", "\x00x", "日本語 テキスト", "👍🏽", "x" * 3000, "\t\ta", "a b"]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.sampled_from(" ▁abthe\n.é日👍"), max_size=40))
def test_pre_tokens_sum_to_the_whole(text):
    cells = K.pre_tokens(text)
    assert sum(K.count_pieces(public_tokenizers.path(K.MODEL), cells)) == len(MODEL.encode(text))


@pytest.mark.parametrize("frequent", [1, 50, K.FREQUENT])
def test_counts_equal_encoding(frame, spark, frequent):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    table = frame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, over_limit boolean")
    rows = {r.doc_id: r for r in K.count_tokens(table, limit=100, frequent=frequent).collect()}
    for i, text in enumerate(texts):
        assert (rows[i].n_tokens, rows[i].n_bytes) == (len(MODEL.encode(text)), len(text.encode())), repr(text[:30])
        assert rows[i].over_limit == (rows[i].n_tokens > 100)


def test_nulls_and_repeated_rows(frame):
    table = frame([(None, None), (None, "two words"), (1, "two words"), (1, "two words"), (1, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in K.count_tokens(table).collect())
    two, other = len(MODEL.encode("two words")), len(MODEL.encode("other"))
    assert got == sorted([(0, 0), (0, two), (1, two), (1, two), (1, other)])
    assert K.count_tokens(table.limit(0)).count() == 0


def test_the_threshold_is_reached_by_at_most_so_many(frame):
    rows = [(f"w{i}", 1 + i * i // 50) for i in range(600)]
    table = frame(rows, "cell string, n long")
    for most in (0, 1, 10, 99, 600, 10_000):
        least = K._threshold(table, most)
        reached = sum(n >= least for _, n in rows) if least is not None else 0
        assert reached <= most and (most < 600 or reached == 600)
        if 10 <= most < 600:
            assert reached > 0.8 * most
    assert K._threshold(table.limit(0), 5) is None
