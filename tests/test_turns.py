from __future__ import annotations

from millrace.plans import numbers


def test_every_turn_is_held_against_the_next(spark, tmp_path):
    rows = [(1, 0, "user", "five green apples"), (1, 1, "assistant", "five apples"), (1, 2, "user", "seven apples remain"), (1, 4, "assistant", "seven"), (2, 3, "user", "alone"), (3, 5, "user", "nine"), (3, 6, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.edits, r.lost, r.added) for r in numbers.turn_alignment(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 1, 0), (1, 1): (2, 0, 1), (1, 2): (2, 2, 0), (3, 5): (1, 1, 0)}
    assert numbers.turn_number_outcomes(spark, str(tmp_path)).first().asDict() == {"kept": 2, "changed": 1, "lost": 1, "invented": 0}
