"""Pre-token sums equal the library's count of the whole text, on random awkward texts."""

import random

from parlance.llm import tokens


def test_fuzz():
    processor = tokens.processor(tokens.model_path())
    rng = random.Random(12)
    alphabets = ["ab \n▁", "a ▁", "aé▁ \t\n\r\x0b\x00　 ａ", "<s></s>unk ▁", "▁\n", "the of ▁.,1\U0001f600�​﻿"]
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 14)))
        assert sum(tokens.piece_count(x, processor) for x in tokens.pre_tokens(text)) == len(processor.encode(text)), repr(text)
