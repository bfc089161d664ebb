"""What one stage leaves in a worker is given up before the next one works there."""

import public_tokenizers
import pyarrow as pa

from emberscan.llm import token_ids
from emberscan.llm.stage import lean


def test_the_next_stage_does_not_hold_an_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    before = token_ids.encoder(path).encode(["some words"])[0].tolist()
    batch = pa.record_batch({"x": pa.array([1, 2])})
    held = []

    def run(batches):
        for b in batches:
            held.append(len(token_ids._encoders))
            yield b

    assert [b.num_rows for b in lean(run)(iter([batch, batch]))] == [2, 2]
    assert held == [0, 0] and not token_ids._encoders
    assert token_ids.encoder(path).encode(["some words"])[0].tolist() == before
