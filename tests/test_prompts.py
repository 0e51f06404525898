from pyspark.sql import functions as F

from plywise.functions import prompts

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def test_board_and_side(spark):
    df = spark.createDataFrame([(START,)], "fen string")
    board, side = df.select(prompts.ascii_board(F.col("fen")), prompts.side_to_move(F.col("fen"))).first()
    assert board.split("\n") == ["r n b q k b n r", "p p p p p p p p", *[". . . . . . . ."] * 4, "P P P P P P P P", "R N B Q K B N R"] and side == "white"


def test_strict_prompt_with_feedback(spark):
    df = spark.createDataFrame([(START, ["e2e4", "a2a3"])], "fen string, legal array<string>")
    feedback = prompts.feedback_text(F.lit("illegal_move"), F.lit("zz"), F.lit("it's bad"), F.col("legal"), F.lit(2))
    empty = F.lit("")
    values = {"fen": F.col("fen"), "side": F.lit("white"), "san_history": empty, "own_moves": empty, "last_opponent_move": F.lit(None).cast("string"),
              "legal_moves": F.col("legal"), "attempted_move": F.lit("zz"), "feedback": feedback}
    lines = df.select(prompts.strict_prompt(values, constrained=False, feedback=True)).first()[0].split("\n")
    assert lines[-1] == ("Previous attempt feedback: {'error': 'illegal_move', 'attempted_move': 'zz', 'reason': \"it's bad\", "
                         "'legal_moves': ['a2a3', 'e2e4'], 'remaining_retries': 2}")
    assert "SAN history: (start position)" in lines and "Last opponent move: (none)" in lines and "Legal moves (UCI): a2a3, e2e4" in lines
    assert 'Return only strict JSON in this exact shape: {"move":"e2e4"}.' in lines


def test_hash_follows_the_template_not_the_position():
    open_hash = prompts.skeleton_hash(prompts.strict_template(constrained=False))
    assert open_hash == prompts.skeleton_hash(prompts.strict_template(constrained=False))
    assert open_hash != prompts.skeleton_hash(prompts.strict_template(constrained=True)) and len(open_hash) == 64
