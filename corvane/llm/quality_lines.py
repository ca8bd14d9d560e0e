"""Line-first quality cleaning: rules per line, then per document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import texts

SPACES = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: A document goes when the lines that fail hold over this share of its words (percent).
MAX_LOST_PCT = 50
#: Of a line's words: symbols (percent), and the commonest word (percent, from LONG_LINE words on).
MAX_SYMBOL_PCT, MAX_SAME_PCT, LONG_LINE = 30, 50, 10
MAX_SEPARATORS, MIN_PHRASE_PCT, SHOUT_LETTERS = 1, 10, 20

#: A line's end: a mark that ends a sentence, perhaps one space, and any number of closing quotes, brackets or emphasis.
MARKS, THIN, CLOSERS = ".!?…:;。！？；：؟।", " \u00a0\u202f", "\")'\\]}”’»」』*_"
#: Words that part the items of a menu.
SEPARATORS = ("|", "»", "›", ">", "·", "•", "::")
# Phrases that page furniture is made of, lower case, in English, German, French and Spanish.
PHRASES = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|uses cookies|accept cookies|"
    r"enable javascript|javascript is (?:disabled|required)|lorem ipsum|sign up for|log ?in to|click here|read more|"
    r"share (?:this|on)|follow us|subscribe to|skip to (?:main )?content|back to top|page \d+ of \d+|powered by|"
    r"licensed under|copyright ©|© ?\d{4}|\(c\) ?\d{4}|"
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl[äa]rung|cookie-richtlinie|wir verwenden cookies|verwendet cookies|cookies akzeptieren|"
    r"javascript aktivieren|jetzt anmelden|hier klicken|weiterlesen|mehr lesen|folgen sie uns|zum inhalt springen|nach oben|seite \d+ von \d+|lizenziert unter|"
    r"tous droits réservés|conditions d['’]utilisation|politique de confidentialité|nous utilisons des cookies|utilise des cookies|accepter les cookies|"
    r"activez javascript|inscrivez-vous|cliquez ici|lire la suite|suivez-nous|abonnez-vous|aller au contenu|haut de (?:la )?page|page \d+ sur \d+|sous licence|"
    r"todos los derechos reservados|t[ée]rminos de (?:uso|servicio)|política de privacidad|política de cookies|utilizamos cookies|utiliza cookies|aceptar cookies|"
    r"active javascript|regístrese|haga clic aquí|leer más|síganos|síguenos|suscríbase|saltar al contenido|volver arriba|página \d+ de \d+|bajo licencia"
)


def _hints(pattern: str) -> tuple[str, ...]:
    """For each phrase of an alternation its longest run of plain characters, without which it can't match."""
    alone = re.sub(r"\(\?:[^)]*\)\??|\[[^\]]*\]|\\d(?:\+|\{\d\})|.\?", "\n", pattern)
    return tuple({max(re.sub(r"\\(.)", r"\1", x).split("\n"), key=len) for x in alone.split("|")})


HINTS = _hints(PHRASES.pattern)
RULES = ("punctuation", "navigation", "symbols", "shouting", "repetition", "boilerplate", "repeated_line")


def ended(line: str) -> bool:
    """Whether a line without white space at its end ends a sentence."""
    end = line.rstrip(CLOSERS)
    return end.endswith(tuple(MARKS)) or end.endswith(tuple(THIN)) and end[:-1].endswith(tuple(MARKS))


def failed_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words breaks."""
    end = line.rstrip(SPACES)
    if not ended(end):
        return "punctuation"
    n = len(words)
    if sum(map(words.count, SEPARATORS)) > MAX_SEPARATORS:
        return "navigation"
    raw = line.encode()
    if 100 * (len(raw) - len(raw.translate(None, SYMBOLS))) > MAX_SYMBOL_PCT * n:
        return "symbols"
    if line.upper() == line and sum(map(str.isupper, line)) >= SHOUT_LETTERS:
        return "shouting"
    if n >= LONG_LINE and 100 * Counter(words).most_common(1)[0][1] > MAX_SAME_PCT * n:
        return "repetition"
    low = line.lower()
    if any(h in low for h in HINTS):
        found = PHRASES.findall(low)
        if found and 100 * sum(map(len, found)) >= MIN_PHRASE_PCT * len(end):
            return "boilerplate"
    return None


def split_words(text: str) -> list[str]:
    """Words between the six ASCII white-space characters; other white space belongs to a word."""
    words = text.split()
    return words if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().split()]


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, free = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, free)
            free = i + 3
    return total


def judge(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, and a line's rule for each that fails."""
    spaced = text.encode()
    words = [w.decode() for w in spaced.split()]
    n = len(words)
    chars = len(text) - (len(spaced) - len(spaced.translate(None, SPACES.encode())))
    symbols = len(spaced) - len(spaced.translate(None, SYMBOLS))
    seen: set[str] = set()
    dups, lost, broken = 0, 0, Counter()
    for line in text.split("\n"):
        own = split_words(line)
        if not own:
            continue
        rule = "repeated_line" if line in seen else failed_rule(line, own)
        dups += line in seen
        seen.add(line)
        if rule:
            broken[rule] += 1
            lost += len(own)
    repeats = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    return n, chars, symbols, dups, repeats, base, not base and 100 * lost <= MAX_LOST_PCT * n, lost, dict(broken)


def cleaned(text: str) -> str:
    """The lines that pass; lines without words stay where they are."""
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        own = split_words(line)
        if not own or line not in seen and not failed_rule(line, own):
            out.append(line)
        if own:
            seen.add(line)
    return "\n".join(out)


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, failed_lines map<string,long>"


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, figures, kept, lost_words, failed_lines) for each row of docs, in one pass without a shuffle.

    A null or empty text has no words and fails the base; repeated rows are
    judged alike; other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.map_(pa.string(), pa.int64())]
        names = [x.split()[0] for x in STATS.split(", ")]
        for b in batches:
            columns = list(zip(*map(judge, texts(b.column(1))), strict=True)) or [()] * len(kinds)
            columns[-1] = [list(x.items()) for x in columns[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, {STATS}")


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all its columns, whatever they are called; their texts are whole, see clean_lines for the lines that pass.

    A null or empty text has no words and goes; texts of any length are read
    whole; repeated rows stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([judge(t)[6] for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clean_lines(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The kept rows of docs with the lines that fail taken out of their texts; chars_col, if named and there, is set to the new length.

    A null or empty text has no words and goes; texts of any length are read
    whole; repeated rows stay or go together, cleaned alike; other columns,
    whatever they are called, stay; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            b = b.filter(pa.array([judge(t)[6] for t in texts(b.column(at))], pa.bool_()))
            new = [cleaned(t) for t in texts(b.column(at))]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if chars_col in b.schema.names:
                k = b.schema.get_field_index(chars_col)
                b = b.set_column(k, b.schema.field(k), pa.array(list(map(len, new)), b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


_LISTED = ", ".join(f"'{x}'" for x in SEPARATORS)
_ENDED = f"[{MARKS}][{THIN}]?[{re.escape(CLOSERS)}]*$".replace("'", "''")
_PHRASES = PHRASES.pattern.replace("'", "''")
#: The same figures and verdicts for DuckDB.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
s AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM s),
rep AS (SELECT r, count(DISTINCT i + k) AS repeats FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
l1 AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, len(own) AS n, again OR NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '{_ENDED}')
    OR len(list_filter(own, lambda x: x IN ({_LISTED}))) > {MAX_SEPARATORS}
    OR 100 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > {MAX_SYMBOL_PCT} * len(own)
    OR (upper(line) = line AND len(regexp_extract_all(line, '\p{{Lu}}')) >= {SHOUT_LETTERS})
    OR (len(own) >= {LONG_LINE} AND 100 * len(list_filter(own, lambda x: x = list_aggregate(own, 'mode'))) > {MAX_SAME_PCT} * len(own))
    OR (regexp_matches(lower(line), '{_PHRASES}') AND 100 * list_sum(list_transform(regexp_extract_all(lower(line), '{_PHRASES}'), lambda x: length(x))) >= {MIN_PHRASE_PCT} * length(regexp_replace(line, '[\x20\x09-\x0D]+$', ''))) AS failed FROM l1),
l AS (SELECT r, count(*) FILTER (again) AS dups, coalesce(sum(n) FILTER (failed), 0) AS lost FROM l2 GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words FROM w LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * lost_words <= {MAX_LOST_PCT} * n_words AS kept FROM b
"""
