"""Notation-aware tokens of a text, as one expression over arrays."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions.dialect import column

_LETTER = "0-9A-Za-zÀ-ɏЀ-ӿ"
_CORE = "RR(RR(c, '^[({<«\"‹]+', ''), '[)}>»\"›,;:]+$', '')"
_SAN = "(?:O-O-O|O-O|[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|(?:[a-h]x)?[a-h][1-8](?:=[KQRBN])?)"
_WORD = "^[A-Za-zÀ-ɏЀ-ӿ]{4,}$"  # a plain word, that can be no move
_NUMBERED = "case when RL(k, '^[0-9]+[.]+.+$') then EX(k, '^[0-9]+[.]+(.+)$', 1) else k end"
_BODY = "case when RL(p.b, '^[0oO]-[0oO]-[0oO]$') then 'O-O-O' when RL(p.b, '^[0oO]-[0oO]$') then 'O-O' when RL(p.b, '^[KQRBN]?[a-h]?[1-8]?:[a-h][1-8]') then replace(p.b, ':', 'x') else p.b end"
_TAIL = "substr(v.b, length(v.m) + 1)"
_CODE = "replace(replace(replace(replace(replace(replace(v.m, 'K', 'k_'), 'Q', 'q_'), 'R', 'r_'), 'B', 'b_'), 'N', 'n_'), 'O', 'o_')"
_MARKS = f"RR({_TAIL}, '[^-+#=._!?/]', '')"
_IS_MOVE = f"v.m <> '' and not RL({_TAIL}, '[0-9A-Za-z]')"
_CORES = "FILTER(MAP(SPLIT(translate({x}, '♔♕♖♗♘♚♛♜♝♞–—−', 'KQRBNKQRBN---'), '[ \n\t]+'), c, " + _CORE + "), k, k <> '' and not RL(k, '^[0-9]+[.]*$'))"
#: tokens of a text {x}: moves in their case code (also with their number), results, marks, and words. Each chunk's
#: core, body and move are bound once, by nested maps.
_BOUND = f"MAP(MAP(MAP({_CORES}, k, PAIR(k, case when RL(k, '{_WORD}') then '' else {_NUMBERED} end)), p, PAIR(p.k, {_BODY})), q, TRIPLE(q.k, q.b, case when q.b = '' then '' else EX(q.b, '^({_SAN}[+#]?)', 1) end))"
TOKENS = (
    f"flatten(MAP({_BOUND}, v, case when v.b = '' then LIST(lower(v.k)) when RL(v.k, '^(1-0|0-1|1/2-1/2|[*])$') then LIST(v.k) when {_IS_MOVE} and RL(v.k, '^[0-9]+[.]') then LIST(EX(v.k, '^([0-9]+[.]+).+$', 1) || {_CODE}, {_CODE}) "
    f"when {_IS_MOVE} and RL({_MARKS}, '[-!?+=/#]') then LIST({_CODE}, {_MARKS}) when {_IS_MOVE} then LIST({_CODE}) when not RL(v.k, '[{_LETTER}]') then NONE() else FILTER(SPLIT(lower(v.k), '[^{_LETTER}]+'), w, w <> '') end))"
)


def tokens(text: str) -> Column:
    """Tokens of a text column, in order; a numbered move also gives the bare one."""
    return column(TOKENS, x=text)
