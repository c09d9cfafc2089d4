"""The scalar functions: notation, boards, headers, text, boxes, colours, confidence."""

from __future__ import annotations

from pyspark.sql import Column

from .dialect import column

# The canonical move, move marks.
SAN = "(?:[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|(?:[a-h]x)?[a-h][1-8](?:=[QRBN])?|O-O-O|O-O)[+#]?"
MARKS = "(?:!!|[?][?]|![?]|[?]!|!|[?])?"

TEMPLATES: dict[str, str] = {
    # moves
    "is_notation": f"RL({{x}}, '^{SAN}$')",
    "piece": "case when {x} like 'O-O%' then 'K' else EX({x}, '^([KQRBN])', 1) end",
    "is_capture": "({x} like '%x%')",
    "is_check": "({x} like '%+')",
    "is_mate": "({x} like '%#')",
    "to_square": "EX({x}, '([a-h][1-8])(?:=[QRBN])?[+#]?$', 1)",
    "promotion": "EX({x}, '=([QRBN])', 1)",
    "disambiguator": "EX({x}, '^[KQRBN]([a-h]?[1-8]?)x?[a-h][1-8]', 1)",
    "suffix": "EX({x}, '([+#]?)$', 1)",
    "is_castling": "({x} like 'O-O%')",
    "encode_case": "lower(RR({x}, '([A-Z])', '{up}'))",
    "relaxed_term": "(RR({x}, '[+#]$', '') || '|' || RR({x}, '[+#]$', '') || '+|' || RR({x}, '[+#]$', '') || '#')",
    "canonical_castling": "case when RL({x}, '^[0oO]-?[0oO]-?[0oO][+#]?$') then 'O-O-O' || EX({x}, '([+#]?)$', 1) when RL({x}, '^[0oO]-?[0oO][+#]?$') then 'O-O' || EX({x}, '([+#]?)$', 1) else {x} end",
    "move_number": "TRYINT(EX({x}, '^([0-9]+)[.]', 1))",
    "after_number": "RR({x}, '^[0-9]+[.]+', '')",
    "core_of_move": "RR({x}, '[!?+#]+$', '')",
    "tail_of_move": "EX({x}, '([!?+#]*)$', 1)",
    "looks_like_move": "RL({x}, '^[A-Za-z]?[a-h]?[1-8]?[x:]?[a-h][1-8](=?[QRBN])?[+#!?]*$|^[0Oo]-[0Oo]')",
    "figurine": "(translate(EX({x}, '^([KQRBN]?)', 1), 'KQRBN', '♔♕♖♗♘') || RR({x}, '^[KQRBN]', ''))",
    "from_figurine": "translate({x}, '♔♕♖♗♘', 'KQRBN')",
    "to_german": "(translate(EX({x}, '^([KQRBN]?)', 1), 'KQRBN', 'KDTLS') || translate(RR({x}, '^[KQRBN]', ''), 'QRBN', 'DTLS'))",
    "from_german": "(translate(EX({x}, '^([KDTLS]?)', 1), 'KDTLS', 'KQRBN') || translate(RR({x}, '^[KDTLS]', ''), 'DTLS', 'QRBN'))",
    "to_spanish": "(translate(EX({x}, '^([KQRBN]?)', 1), 'KQRBN', 'RDTAC') || translate(RR({x}, '^[KQRBN]', ''), 'QRBN', 'DTAC'))",
    "piece_letter": "case {lang} when 'en' then translate({x}, 'KQRBN', 'KQRBN') when 'de' then translate({x}, 'KQRBN', 'KDTLS') when 'es' then translate({x}, 'KQRBN', 'RDTAC') when 'fr' then translate({x}, 'KQRBN', 'RDTFC') when 'pt' then translate({x}, 'KQRBN', 'RDTBC') else null end",
    "piece_for_letter": "case {lang} when 'en' then {x} when 'de' then translate({x}, 'KDTLS', 'KQRBN') when 'es' then translate({x}, 'RDTAC', 'KQRBN') when 'fr' then translate({x}, 'RDTFC', 'KQRBN') when 'pt' then translate({x}, 'RDTBC', 'KQRBN') else null end",
    "rendered_move": "case when {style} = 'figurine' then translate(EX({x}, '^([KQRBN]?)', 1), 'KQRBN', '♔♕♖♗♘') || RR({x}, '^[KQRBN]', '') else {x} end",
    "nag_symbol": "case {x} when 1 then '!' when 2 then '?' when 3 then '!!' when 4 then '??' when 5 then '!?' when 6 then '?!' when 10 then '=' when 13 then '∞' when 14 then '⩲' when 15 then '⩱' when 16 then '±' when 17 then '∓' when 18 then '+-' when 19 then '-+' else '' end",
    "nag_code": "case {x} when '!' then '$1' when '?' then '$2' when '!!' then '$3' when '??' then '$4' when '!?' then '$5' when '?!' then '$6' when '=' then '$10' when '∞' then '$13' else null end",
    "nag_name": "case {x} when 1 then 'good move' when 2 then 'mistake' when 3 then 'brilliant move' when 4 then 'blunder' when 5 then 'interesting move' when 6 then 'dubious move' else 'NAG ' || STR({x}) end",
    # boards: board64 is eight ranks of eight characters, '.' for an empty square, rank 8 first
    "placement": "EL(SPLIT(trim({x}), ' '), 1)",
    "white_to_move": "coalesce(EL(SPLIT({x}, ' '), 2) <> 'b', true)",
    "board64": "replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '/', ''), '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.')",
    "run_length": "replace(replace(replace(replace(replace(replace(replace(replace({x}, '........', '8'), '.......', '7'), '......', '6'), '.....', '5'), '....', '4'), '...', '3'), '..', '2'), '.', '1')",
    "piece_count": "INT(length({x}) - length(replace({x}, {p}, '')))",
    "piece_at": "substr({x}, INT({i}) + 1, 1)",
    "square_index": "INT((CODE(substr({x}, 2, 1)) - 49) * 8 + CODE(substr({x}, 1, 1)) - 97)",
    "square_name": "(chr(INT(97 + {x} % 8)) || chr(INT(49 + floor({x} / 8))))",
    "is_square_name": "RL({x}, '^[a-h][1-8]$')",
    "rotated": "REV({x})",
    "material": "(RR(RR(split_part({x}, ' ', 1), '[^A-Z]', ''), 'K', '') || 'v' || upper(RR(RR(split_part({x}, ' ', 1), '[^a-z]', ''), 'k', '')))",
    "fen_side": "EL(SPLIT({x}, ' '), 2)",
    "fen_castling": "EL(SPLIT({x}, ' '), 3)",
    "fen_ep": "EL(SPLIT({x}, ' '), 4)",
    "fen_half": "TRYINT(EL(SPLIT({x}, ' '), 5))",
    "fen_full": "TRYINT(EL(SPLIT({x}, ' '), 6))",
    "fen_ok": "(SIZE(SPLIT(split_part({x}, ' ', 1), '/')) = 8 and RL({x}, '^[1-8pnbrqkPNBRQK/]+( [wb]( (-|[KQkq]+)( (-|[a-h][36])( [0-9]+( [0-9]+)?)?)?)?)?$'))",
    # headers and dates
    "header_year": "case when RL(substr({x}, 1, 4), '^[0-9]{4}$') then INT(substr({x}, 1, 4)) else 0 end",
    "pgn_date": "case when RL({x}, '^[0-9]{4}$') then {x} || '.??.??' when RL({x}, '^[0-9]{4}[.-][0-9]{1,2}$') then substr({x}, 1, 4) || '.' || lpad(EX({x}, '[.-]([0-9]{1,2})$', 1), 2, '0') || '.??' when RL({x}, '^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}$') then substr({x}, 1, 4) || '.' || lpad(EX({x}, '^[0-9]{4}[./-]([0-9]{1,2})', 1), 2, '0') || '.' || lpad(EX({x}, '([0-9]{1,2})$', 1), 2, '0') when RL({x}, '^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}$') then EX({x}, '([0-9]{4})$', 1) || '.' || lpad(EX({x}, '^[0-9]{1,2}[./-]([0-9]{1,2})', 1), 2, '0') || '.' || lpad(EX({x}, '^([0-9]{1,2})', 1), 2, '0') else '????.??.??' end",
    "pgn_result": "case when trim({x}) in ('1-0', '0-1', '1/2-1/2') then trim({x}) when trim({x}) in ('½-½', '½', '=', '0.5-0.5', '1/2') then '1/2-1/2' else '*' end",
    "header": "EX({x}, '[[]' || {tag} || ' \"([^\"]*)\"', 1)",
    "start_fen": "coalesce(nullif(EX({x}, '[[]FEN \"([^\"]*)\"', 1), ''), 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1')",
    "segment_title": "case when EX({x}, '[[]White \"([^\"]*)\"', 1) <> '' then EX({x}, '[[]White \"([^\"]*)\"', 1) || ' - ' || EX({x}, '[[]Black \"([^\"]*)\"', 1) else 'Game ' || STR({i}) end",
    "header_problems": "((case when EX({x}, '[[]White \"([^\"]*)\"', 1) in ('', '?') then 1 else 0 end) + (case when EX({x}, '[[]Black \"([^\"]*)\"', 1) in ('', '?') then 1 else 0 end) + (case when not RL(EX({x}, '[[]Date \"([^\"]*)\"', 1), '^([0-9]{4}|[?]{4})[.]([0-9]{2}|[?]{2})[.]([0-9]{2}|[?]{2})$') then 1 else 0 end) + (case when EX({x}, '[[]Result \"([^\"]*)\"', 1) not in ('1-0', '0-1', '1/2-1/2', '*') then 1 else 0 end))",
    # comments
    "without_commands": "trim(RR(RR({x}, '[[]%[a-z]+ [^]]*[]]', ''), ' +', ' '))",
    "commands": "JOIN(ALL({x}, '[[]%[a-z]+ [^]]*[]]'), ' ')",
    "escaped_comment": "translate({x}, '{}', '()')",
    "diagram_marks": "SIZE(ALL({x}, '[[]#[]]|[{][#][}]|<diagram>|[(]D[)]'))",
    "normal_diagram_marks": "RR({x}, '[[]#[]]|<diagram>|[(]D[)]', '{mark}')",
    "book_symbols": "translate({x}, '□△∆⌓', '□∆∆⌓')",
    # text
    "fingerprint": "lower(RR(RR(trim({x}), '[0-9]+', '#'), '[ ]+', ' '))",
    "is_page_number": "RL(lower(trim(RR({x}, '[^0-9A-Za-z]', ' '))), '^([0-9]{1,4}|[ivxlcdm]+)?$')",
    "folded_ligatures": "replace(replace(replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')",
    "snippet": "RR(substr({x}, INT(greatest({s} - 60, 1)), INT({n})), '[ ]+', ' ')",
    "locate": "INT(case when instr({x}, {t}) > 0 then instr({x}, {t}) else instr(lower({x}), lower({t})) end)",
    "word_tokens": "ALL({x}, '[A-Za-zÀ-ÿЀ-ӿ]+|[0-9]+|[^A-Za-zÀ-ÿЀ-ӿ0-9 ]+')",
    "prose_tokens": "ALL({x}, '[A-Za-zÀ-ÿЀ-ӿ0-9]+')",
    "implausible_token": "(RL({x}, '[A-Za-zÀ-ÿ][0-9]+[A-Za-zÀ-ÿ]') or (RL({x}, '[A-Za-z]') and RL({x}, '[Ѐ-ӿ]')) or RL(lower({x}), '^[bcdfghjklmnpqrstvwxz]{4,}$'))",
    "cyrillic_share": "case when length(RR({x}, '[^A-Za-zÀ-ÿЀ-ӿ]', '')) = 0 then 0.0 else round(DBL(length(RR({x}, '[^Ѐ-ӿ]', ''))) / length(RR({x}, '[^A-Za-zÀ-ÿЀ-ӿ]', '')), 6) end",
    "latin_chars": "INT(length(RR({x}, '[^A-Za-zÀ-ÿ]', '')))",
    "cyrillic_chars": "INT(length(RR({x}, '[^Ѐ-ӿ]', '')))",
    "odd_char_ratio": "case when length({x}) = 0 then 0.0 else round(DBL(length(RR({x}, '[A-Za-zÀ-ÿЀ-ӿ0-9 .,;:!?()+=#/½♔♕♖♗♘-]', ''))) / length({x}), 6) end",
    "language_code": "case when {x} is null then null when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('en', 'eng', 'english') then 'en' when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('de', 'deu', 'ger', 'german') then 'de' when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('es', 'spa', 'spanish') then 'es' when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('pt', 'por', 'portuguese') then 'pt' when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('fr', 'fra', 'fre', 'french') then 'fr' when lower(split_part(split_part({x}, '-', 1), '+', 1)) in ('ru', 'rus', 'russian') then 'ru' else null end",
    "starts_with_move": "case when RL({x}, '^[0-9]+[.]') then TRYINT(EX({x}, '^([0-9]+)[.]', 1)) else null end",
    "starts_black": "RL({x}, '^[0-9]+[.][.][.]')",
    "after_move": "TRYINT(EX({x}, '(?:After|Nach|Après|Tras|Após|После) ([0-9]+)[.]', 1))",
    "mate_in": "coalesce(TRYINT(nullif(EX(lower({x}), '(?:mate in|matt in|mat en|mate em) ([0-9]+)', 1), '')), TRYINT(nullif(EX({x}, '(?:^|[^0-9A-Za-z] ?)#([0-9]+)$', 1), '')))",
    "caption_label": "EX({x}, '^([^0-9]*[0-9]+)', 1)",
    # boxes
    "overlap_1d": "greatest(0.0, least({a2}, {b2}) - greatest({a1}, {b1}))",
    # confidence
    "lowered_confidence": "case when {verdict} = 'inconsistent' and {v} < {floor} then round({v} * (1 - 0.5 * {l}), 6) else {v} end",
    "severity": "case when {cer} > 0.02 or {conf} < 0.45 then 'bad' when {cer} > 0.005 or {conf} < 0.80 then 'attention' else 'ok' end",
    "decision": "case when {conf} is null then 'abstained' when {conf} >= 0.8 then 'accepted' when {conf} >= 0.45 then 'review' else 'abstained' end",
    "partition": "case when HEXINT(substr(SHA({x}), 1, 4)) < 32768 then 'dev' when HEXINT(substr(SHA({x}), 1, 4)) < 49152 then 'calib' else 'blind' end",
    "ulid_ok": "RL({x}, '^[0-7][0-9A-HJKMNP-TV-Z]{25}$')",
    # units and colours
    "points": "round({v} * case {u} when 'pt' then 1e0 when 'mm' then 72e0 / 25.4e0 when 'cm' then 72e0 / 2.54e0 when 'in' then 72e0 when 'px' then 75e-2 else null end, 6)",
    "red": "HEXINT(substr({x}, 2, 2))",
    "green": "HEXINT(substr({x}, 4, 2))",
    "blue": "HEXINT(substr({x}, 6, 2))",
    "label_parent": "EX({x}, '^(.*)[.][^.]*$', 1)",
}


def call(name: str, **args: str) -> Column:
    """A scalar function applied to column names or SQL, as a Column."""
    return column(TEMPLATES[name], **args)
