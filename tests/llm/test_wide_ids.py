"""Token ids beyond 16 bits are written and read whole."""

from tokenizers import Tokenizer, models, pre_tokenizers

from plumbline.llm import token_records
from plumbline.llm._common import shared_dir


def test_wide_ids(spark, tmp_path):
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocab = {c: 70_000 + k for k, c in enumerate(letters)} | {"<|endoftext|>": 2}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(path := str(tmp_path / "wide.json"))
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    for end_id in (2, 80_000):
        uri = shared_dir(spark, "wide")
        got = {r.doc_id: list(r.ids) for r in token_records.read_token_records(token_records.write_token_records(df, uri, path, end_id=end_id), uri).collect()}
        assert got == {1: [*tokenizer.encode("ab c").ids, end_id], 2: [end_id]} and min(got[1][:-1]) >= 70_000
