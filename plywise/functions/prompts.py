"""Prompt texts rendered as string columns; the hash of a template is a plan-time constant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from plywise.functions.text import listed

# --- Fixed values: prompt wording. Results are compared by text and by template hash. ---
STRICT_VERSION = "strict-v7"
REASONING_VERSION = "reasoning-v1"

STRICT_HEAD = [
    "You are playing a competitive chess game and your goal is to win.",
    "Win by checkmating the opponent's king; if a win is out of reach, "
    "play for a draw rather than a loss.",
    "Among the legal moves, choose the strongest one: develop your pieces, "
    "fight for the center, keep your own king safe, and never give away "
    "material for free.",
    "Before committing, look for checks, captures and threats — both your own "
    "tactical chances and the opponent's threats against you.",
]
STRICT_SHAPE = 'Return only strict JSON in this exact shape: {{"move":"e2e4"}}.'
STRICT_SHAPE_MEMORY = (
    'Return only strict JSON in this exact shape: {{"move":"e2e4","rationale":"short reason",'
    '"strategy_update":{{"objective":"short updated plan"}}}}.'
)
STRICT_NOTATION = (
    "The move value must be UCI coordinate notation, e.g. e2e4, g1f3, "
    "e1g1, e7e8q. Do not use SAN moves like e4, Nf3, O-O, or Qxc4."
)
STRICT_POSITION = [
    "Side to move: {side}.",
    "Current FEN: {fen}",
    "SAN history: {san_history}",
    "Your prior moves: {own_moves}",
    "Last opponent move: {last_opponent_move}",
]
STRICT_BOARD = "ASCII board:\n{ascii_board}"
STRICT_MEMORY = [
    "Your private strategic memory:",
    "- Objective: {objective}",
    "- Opponent threats: {opponent_threats}",
    "- Pieces to improve: {pieces_to_improve}",
    "- Avoid: {avoid}",
    "- Last own move rationale: {last_rationale}",
    "Update this memory after choosing a move. Keep each field short and concrete.",
]
STRICT_REPETITION = "Repetition warning: {repetition_warning}"
STRICT_LEGAL = [
    "Choose exactly one move from this legal move list.",
    "Your move must exactly match one listed UCI move.",
    "If strategic memory conflicts with the legal move list, ignore the memory.",
    "Legal moves (UCI): {legal_moves}",
]
STRICT_FEEDBACK = [
    "Your previous response was invalid.",
    "Do not repeat this attempted move: {attempted_move}.",
    "Choose a different move that exactly appears in the legal move list.",
    "Previous attempt feedback: {feedback}",
]
REASONING = [
    "Annotate an already-scored strict chess move.",
    "Do not propose a different move.",
    "Persona: {persona}.",
    "FEN before move: {fen_before}",
    "Accepted move: {accepted_san} / {accepted_uci}",
    "Engine classification: {evaluation_label}",
    "Return concise commentary for a match report.",
]
RISK = [
    "You are a chess move risk classifier.",
    "",
    "Position:",
    "FEN before: {fen_before}",
    "Side to move: {side_to_move}",
    "Candidate move: {candidate_uci} ({candidate_san})",
    "FEN after candidate: {fen_after}",
    "Opponent legal replies: {opponent_legal_replies}",
    "",
    "Classify whether the candidate is tactically safe.",
    "Return JSON only:",
    '{{"risk":"blunder|mistake|playable|good","blunder":true,"score":0,"reason_type":"material_or_mate"}}',
]
CHOICE = [
    "You are a chess candidate move ranker.",
    "",
    "Position:",
    "FEN: {fen}",
    "Side to move: {side_to_move}",
    "",
    "Candidate moves:",
    "{candidate_lines}",
    "",
    "Choose the best move from the candidate list.",
    "Return JSON only:",
    '{{"move":"<uci>"}}',
]
PAIRWISE = [
    "You are a chess move safety comparator.",
    "",
    "Position:",
    "FEN: {fen}",
    "Side to move: {side_to_move}",
    "",
    "Candidate moves:",
    "{candidate_lines}",
    "",
    "Choose the safer move from the two candidates.",
    "Return JSON only:",
    '{{"move":"<uci>"}}',
]
CANDIDATES = [
    "You are choosing candidate chess moves for the current position.",
    "Your task is NOT to choose a final move yet.",
    "Return a JSON object with a candidates array only.",
    "Do not return a top-level move field.",
    "Required shape:",
    '{{"candidates":[{{"move":"e2e4","idea":"claim center"}}]}}',
    "Generate up to {n_candidates} distinct legal candidate moves.",
    "Do not use an engine. Use only the board, legal moves, and chess reasoning.",
    "",
    "FEN: {fen}",
    "Side to move: {side_to_move}",
    "SAN history: {san_history}",
]
CANDIDATES_BOARD = ["Board:", "{ascii_board}"]
CANDIDATES_LEGAL = "Legal moves: {legal_moves}"
REVISE = [
    "You are reviewing your own chess move before it is played.",
    "",
    "Original position FEN: {fen}",
    "Side to move: {side_to_move}",
    "SAN history: {san_history}",
    "Legal moves from original position: {legal_moves}",
    "Your first chosen move: {candidate_uci} ({candidate_san})",
    "Position after your move: {fen_after}",
    "Opponent legal replies after your move: {opponent_legal_replies}",
    "",
    "Check whether your first move is a blunder.",
    "Focus on forcing replies: checks, captures, threats, mate threats, "
    "attacks on the queen or king, hanging pieces, and ignored opponent threats.",
    "You may keep the move or replace it with a different legal move from the original legal move list.",
    "Return strict JSON only:",
    '{{"move":"e2e4","changed":false,"risk":"short tactical risk note"}}',
]
REFUTE = [
    "You are the opponent trying to refute a candidate chess move.",
    "",
    "Original position FEN: {fen}",
    "Side to move before candidate: {side_to_move}",
    "Candidate move: {candidate_uci} ({candidate_san})",
    "Candidate idea: {candidate_idea}",
    "Position after candidate: {fen_after}",
    "Opponent side to move: {opponent_side}",
    "Opponent legal replies: {opponent_legal_replies}",
    "",
    "Find the most dangerous opponent reply. Look first for checks, captures, "
    "mate threats, attacks on queen or king, and tactics that win material.",
    "Do not use an engine. Reason from the board and legal moves only.",
    "Return strict JSON only:",
    '{{"candidate":"{candidate_uci}","best_reply":"<uci or null>","risk":"low|medium|high|unknown",'
    '"blunder_suspected":true,"reason":"short concrete reason"}}',
]
FINAL = [
    "You must now choose one final chess move.",
    "",
    "Original position FEN: {fen}",
    "Side to move: {side_to_move}",
    "Legal moves: {legal_moves}",
    "Candidate moves, exact UCI only: {candidate_moves}",
    "",
    "Candidate analyses:",
    "{candidate_table}",
    "",
    "Choose the candidate with the lowest tactical risk.",
    "Avoid any move where your own critic found a forcing refutation, mate threat, or clear material loss.",
    "Your final move must be copied exactly from Candidate moves.",
    "If there is only one candidate, choose that exact UCI move.",
    "Do not return SAN, algebraic notation, or a move outside the candidate list.",
    "Return strict JSON only:",
    '{{"move":"e2e4"}}',
]
INITIAL_MEMORY = {
    "objective": "Play active legal chess as {side}; develop pieces, keep the king safe, and improve the position.",
    "opponent_threats": "Identify direct checks, captures, and attacks before choosing a move.",
    "pieces_to_improve": "Develop undeveloped minor pieces and coordinate queen, rooks, and king safety.",
    "avoid": "Avoid moving the same piece repeatedly, exposing the king, or repeating positions without purpose.",
    "last_rationale": "(none)",
}
# --- End of fixed values. ---

MEMORY_FIELDS = tuple(INITIAL_MEMORY)
NO_HISTORY, NONE_TEXT = "(start position)", "(none)"


def render(lines: Sequence[str], values: Mapping[str, Column]) -> Column:
    """One text column from template lines and the columns of their placeholders."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse("\n".join(lines)):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def skeleton_hash(lines: Sequence[str]) -> str:
    """sha256 of the template with its placeholders left in, joined by line feeds."""
    fixed = [line if "{{" not in line else line.replace("{{", "{").replace("}}", "}") for line in lines]
    return sha256("\n".join(fixed).encode()).hexdigest()


def strict_template(
    *, constrained: bool, feedback: bool = False, memory: bool = False, repetition: bool = False, board: bool = True
) -> list[str]:
    lines = [*STRICT_HEAD, STRICT_SHAPE_MEMORY if memory else STRICT_SHAPE, STRICT_NOTATION, *STRICT_POSITION]
    if board:
        lines.append(STRICT_BOARD)
    if memory:
        lines += STRICT_MEMORY
    if repetition:
        lines.append(STRICT_REPETITION)
    if constrained or feedback:
        lines += STRICT_LEGAL
    if feedback:
        lines += STRICT_FEEDBACK
    return lines


def candidate_template(*, board: bool = True, legal_moves: bool = True) -> list[str]:
    return [*CANDIDATES, *(CANDIDATES_BOARD if board else []), *([CANDIDATES_LEGAL] if legal_moves else [])]


def ascii_board(fen: Column) -> Column:
    """Eight ranks of pieces and dots from the placement field of a FEN."""
    cells = F.substring_index(fen, " ", 1)
    for width in range(8, 0, -1):
        cells = F.regexp_replace(cells, str(width), "." * width)
    return F.regexp_replace(F.regexp_replace(cells, r"([^/])(?=[^/])", "$1 "), "/", "\n")


def side_to_move(fen: Column) -> Column:
    return F.when(F.split(fen, " ")[1] == "w", "white").otherwise("black")


def or_none(text: Column, missing: str = NONE_TEXT) -> Column:
    return F.when(text.isNull() | (text == ""), missing).otherwise(text)


def candidate_lines(candidates: Column) -> Column:
    """Numbered ``uci (san)`` lines of an ordered candidate list."""
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["uci"], F.lit(" ("), c["san"], F.lit(")"))
    return F.array_join(F.transform(candidates, line), "\n")


def choice_prompt(fen: Column, side: Column, candidates: Column) -> Column:
    return render(CHOICE, {"fen": fen, "side_to_move": side, "candidate_lines": candidate_lines(candidates)})


def pairwise_prompt(fen: Column, side: Column, candidates: Column) -> Column:
    return render(PAIRWISE, {"fen": fen, "side_to_move": side, "candidate_lines": candidate_lines(candidates)})


def risk_prompt(values: Mapping[str, Column]) -> Column:
    return render(RISK, values)


def reasoning_prompt(values: Mapping[str, Column]) -> Column:
    return render(REASONING, values)


def strict_prompt(values: Mapping[str, Column], **options: bool) -> Column:
    """The move prompt; empty histories read as '(start position)' / '(none)'."""
    filled = dict(values)
    filled["san_history"] = or_none(values["san_history"], NO_HISTORY)
    filled["own_moves"] = or_none(values["own_moves"])
    filled["last_opponent_move"] = or_none(values["last_opponent_move"])
    if options.get("board", True) and "ascii_board" not in filled:
        filled["ascii_board"] = ascii_board(values["fen"])
    if "legal_moves" in filled:
        filled["legal_moves"] = listed(values["legal_moves"])
    if "attempted_move" in filled:
        filled["attempted_move"] = or_none(values["attempted_move"])
    return render(strict_template(**options), filled)


def _quoted(text: Column) -> Column:
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    plain = F.concat(F.lit("'"), F.regexp_replace(text, "'", "\\\\\\\\'"), F.lit("'"))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(plain)


def feedback_text(error: Column, attempted: Column, reason: Column, legal: Column, remaining: Column) -> Column:
    """The feedback record in the notation the prompt shows it."""
    moves = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(legal), _quoted), ", "), F.lit("]"))
    return F.concat(
        F.lit("{'error': "), _quoted(error),
        F.lit(", 'attempted_move': "), _quoted(attempted),
        F.lit(", 'reason': "), _quoted(reason),
        F.lit(", 'legal_moves': "), moves,
        F.lit(", 'remaining_retries': "), remaining.cast("string"), F.lit("}"),
    )
