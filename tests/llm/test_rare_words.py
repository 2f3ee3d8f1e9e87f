"""Toxic words that each stand in few of the toxic texts."""

import random

from contactlake.llm import toxicity


def test_op2_words_in_one_percent_of_the_toxic_texts():
    draw = random.Random(3)

    def word() -> str:
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(6, 9)))

    plain, toxic = [word() for _ in range(2_000)], [word() for _ in range(300)]

    def text(bad: int) -> str:
        out = [draw.choice(plain) for _ in range(80)]
        for at, w in zip(draw.sample(range(80), 3 * bad), draw.sample(toxic, 3 * bad)):
            out[at] = w
        return " ".join(out)

    model = toxicity.train([text(i % 2) for i in range(2_000)], [i % 2 for i in range(2_000)], [1.0] * 2_000)
    found = toxicity.Scorer(model).score([text(i % 2) for i in range(400)]) >= 0.5
    assert found[1::2].mean() > 0.9 and found[0::2].mean() < 0.05
