import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veridale.llm import tokencount
from veridale.llm.queries import op10_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_op10_matches_the_library(spark, small, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for _ in range(2):  # with an empty cache and with a full one
        rows = op10_token_counts(spark, small).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n = plain(texts[r.doc_id])
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_cache_grows_by_misses_only(spark, tmp_path, plain):
    texts = [None, "", " \t", "a  b", "a b", "a\nb ", "<|endoftext|>", "<|ENDOFTEXT|>", " x <|startoftext|>\n y", "é     z\x1c\x85", "w" * 30000, "don't I'LL"]
    rows = [(k, t, 1) for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    for part, size in ((docs.where("doc_id < 5"), 2), (docs, 8), (docs, 8), (docs.limit(0), 8)):
        out = tokencount.token_counts(part, PATH, cache).collect()
        assert len(out) == part.count() and all(r.n_tokens == plain(texts[r.doc_id]) for r in out)
        assert spark.read.parquet(cache).count() == size


def test_other_tokenizers_keep_their_white_space(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    texts = [None, "", "a  b", "a b", "a\n\n b ", " lead", "x" * 50_000, "é\t\t\u3000z"]
    docs = spark.createDataFrame([*enumerate(texts), (3, "a b")], "doc_id long, text string")
    json_path, model_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert tokencount.folds_space(PATH) and not tokencount.folds_space(json_path) and not tokencount.folds_space(model_path)
    library, pieces = Tokenizer.from_file(json_path), SentencePieceProcessor(model_file=model_path)
    for path, count in ((json_path, lambda t: len(library.encode(t, add_special_tokens=False).ids)), (model_path, lambda t: len(pieces.encode(t)))):
        got = tokencount.token_counts(docs, path, str(tmp_path / "one")).collect()
        assert len(got) == 9 and all(r.n_tokens == count(texts[r.doc_id] or "") for r in got)


def test_words_have_the_tokens_of_their_text(monkeypatch):
    """Words one by one against whole texts: marks, special strings, other blanks, and letters that fold."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(6)
    pieces = ["don't", "'s", "l'll", "<|endoftext|>", "x<|startoftext|>y", "́", "é", " ", " ", "\u0085", "\x1c", "\x1f!", "ΣΑΣ", "İ", "ß", "日本語", "٣", "１２", "...", "?!", "a" * 70, "​", "\U0001f600", "\U00010330", "ﬁ", "…", "", "№5"]
    texts = [" ".join(rng.choice(pieces) + rng.choice(["", rng.choice(pieces)]) for _ in range(rng.randrange(12))) for _ in range(400)]
    assert tokencount.folds_space(path)
    monkeypatch.setattr(tokencount, "WORDS", 5)
    count = tokencount._counter(path, True)
    got = [n for k in range(0, 400, 50) for n in count(texts[k : k + 50])]
    assert got == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts] and sum(got) > 1000
