import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from pileline.llm import tokens


@pytest.fixture(scope="module")
def pieces():
    return tokens.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def library_count(tokenizer, text):
    return len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


TEXTS = ["", " ", "  ", "a", "hello   world\n a ", "ööö ñandú 梦 \U0001f600\U0001f601 x", "\t\n\r\x0b mixed\n\n lines ", "▁ a▁b", "ererererer thththth " * 50, "x" * 500, "<0x41> <s> </s> <unk>"]


def test_count_is_that_of_the_library(pieces):
    library = Tokenizer(models.Unigram(pieces, 0, True))
    counter = tokens.UnigramCounter(pieces)
    assert counter.parts_apart
    r = random.Random(1)
    alphabet = [p for p, _ in pieces if p and not p.startswith("<")][:3000]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))).replace("▁", " ") for _ in range(300)]
    texts += ["".join(chr(r.choice([32, 97, 98, 233, 0x4E00, 0x1F600, 10])) for _ in range(30)) for _ in range(200)]
    for t in texts:
        assert counter.count(t) == library_count(library, t), t
        marked = "▁" + t.replace(" ", "▁")
        if t:
            assert counter.count_part(marked) == counter.count(t)


@pytest.mark.parametrize("seed", range(30))
def test_ties_and_unknown_signs_against_the_library(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(25)})
    vocabulary = [("<unk>", 0.0)] + [(w, -float(r.randrange(1, 6)) * len(w)) for w in words]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    counter = tokens.UnigramCounter(vocabulary, False)
    for _ in range(40):
        t = "".join(r.choice("abcd") for _ in range(r.randrange(1, 30)))
        assert counter.count_part(t) == len(library.encode(t, add_special_tokens=False).ids), (vocabulary, t)


def test_rows(spark, pieces):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5)], "doc_id long, text string, n_tokens int")
    n = library_count(Tokenizer(models.Unigram(pieces, 0, True)), "hello world")
    assert sorted((x.doc_id, x.n_tokens) for x in tokens.count_tokens(df, pieces).collect()) == [(1, 0), (2, 0), (3, n), (3, n)]
    assert tokens.count_tokens(df.limit(0), pieces).count() == 0
