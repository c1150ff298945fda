import random

import public_tokenizers
from cases import LONG, edge_docs, edge_texts, empty_docs
from tokenizers import Tokenizer

from ebbflow.llm import bpe
from ebbflow.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library_on_documents_and_edge_cases(spark):
    known = library()
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_decode(docs, PATH).collect():
        want = known.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == known.decode(want, skip_special_tokens=False)
    rows = bpe.encode_decode(edge_docs(spark), PATH).collect()
    want = sorted((str(i), known.encode(t or "", add_special_tokens=False).ids) for i, t in edge_texts())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert bpe.encode_decode(empty_docs(spark), PATH).count() == 0


def test_odd_texts():
    known, own = library(), bpe.load(PATH)
    r = random.Random(5)
    letters = "abcXYZ01 .,'\n\té́ßİΣ中\U0001f600"
    texts = ["", "x" * 5000, LONG[:3000], "It's we'll I'd 'S", "<|endoftext|>a<|startoftext|><|endoftext|>", "<|endof", "ΟΔΟΣ"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    for text in texts:
        want = known.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, text
        assert own.decode(own.encode(text)) == known.decode(want, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    own = bpe.load(PATH)
    r = random.Random(9)
    for _ in range(200):
        raw = "".join(r.choice("aeinrst") for _ in range(r.randint(1, 90))).encode()
        parts = [*(own.inner[b] for b in raw[:-1]), own.last[raw[-1]]]
        assert own.merge_short(list(parts)) == own.merge_long(list(parts))
