import random

import pyarrow as pa
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from stormlake.llm.tokens import ByteBpe, Encoder, PieceBpe, Segments

JSON, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def read(name):
    with open(name, "rb") as file:
        return file.read()


def texts():
    rng = random.Random(1)
    parts = list("ab c'sdltve  \n\t\r.,1é \u0085  　。漢​\x1c\x1f\x00 ñ𝒳 \U0001f600 ") + ["<|endoftext|>", "  ", "   ", "<0x41>", "<s>"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    return out + [chr(c) + " " + chr(d) + chr(c) for c in range(1, 0x240, 3) for d in range(1, 0x240, 29)]


def ours(encoder, rows):
    segments = Segments(pa.array(rows, pa.string()), encoder.tokenizer.cuts)
    ids, first = encoder.encode(segments, segments.hashes())
    at = first[segments.first]
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))]


def test_byte_level_ids_equal_the_tokenizers():
    rows = texts()
    for special in (True, False):
        whole = Tokenizer.from_file(JSON)
        whole.encode_special_tokens = not special
        want = [e.ids for e in whole.encode_batch(rows, add_special_tokens=False)]
        tokenizer = ByteBpe(read(JSON), special)
        assert tokenizer.cuts and tokenizer.ranked
        assert ours(Encoder(tokenizer), rows) == want
        # a small memory is emptied again and again
        small = Encoder(tokenizer, remembered=50)
        assert [ours(small, rows[i : i + 40]) for i in range(0, 400, 40)] == [want[i : i + 40] for i in range(0, 400, 40)]


def test_piece_ids_equal_the_model():
    rows = [t for t in texts() if t] + ["a ▁ b", "▁", "x▁ y"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokenizer = PieceBpe(read(MODEL))
    assert tokenizer.cuts
    assert ours(Encoder(tokenizer), [" " + t for t in rows]) == [model.encode(t) for t in rows]


def test_nothing():
    assert ours(Encoder(ByteBpe(read(JSON), True)), []) == []
    assert ours(Encoder(ByteBpe(read(JSON), True)), [None, ""]) == [[], []]
