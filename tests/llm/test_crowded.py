"""Turn numbers with very many rows."""

from contactlake.llm import chat


def test_op8_crowded_turns_have_one_result(spark):
    rows = [(1, 3, "bob" if i % 3 else "ann", f"t{i * 7919 % 1000:03d}") for i in range(700)]
    rows += [(1, 3, "bob", "same")] * 600 + [(1, None, "ann", f"n{i}") for i in range(300)]
    rows += [(1, 1, "ann", "hi"), (1, 2, "bob", "yes"), (1, 5, "ann", "bye"), (2, 1, "ann", "alone")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")

    def out(df):
        return sorted(map(tuple, chat.rotate(df).select("conv_id", "speaker", "block", "part", "n_turns", "text", "masks").collect()))

    got = out(turns)
    assert got == out(turns.repartition(7)) and max(r[4] for r in got) <= chat.BLOCK_TURNS
    mine = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    whole = "".join(
        f"<|im_start|>{'assistant' if r == 'ann' else 'user name=' + r}\n{t}<|im_end|>\n" for _, _, r, t in mine
    )
    ann = [r for r in got if r[:2] == (1, "ann")]
    assert len({r[3] for r in ann}) == len(ann) and "".join(r[5] for r in ann) == whole
    said = [r[5][m.start : m.end] for r in ann for m in r[6]]
    assert said == [f"{t}<|im_end|>" for _, _, r, t in mine if r == "ann"]
