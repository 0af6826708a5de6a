"""Texts that hold the tokenizer's added tokens literally."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from jobgrain.llm import packing


def test_added_tokens_keep_their_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["say <|endoftext|> now", "in<|startoftext|>side", "Say <|ENDOFTEXT|>\n now", "<|endoftext|><|endoftext|>", "plain text", ""]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = packing.pack_documents(rows, path, window=4096, end_id=2).toPandas().set_index("doc_id")
    tokenizer = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        want = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert got.doc_tokens[i] == len(want)
        assert np.frombuffer(got.ids[i], dtype="<u4").tolist() == want
