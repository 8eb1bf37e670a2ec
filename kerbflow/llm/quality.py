"""Quality rules: repetition and symbol counts, and tokeniser fertility under a public vocabulary (characters per
token, share of byte-fallback tokens, token entropy) with rejection bands per language or script."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkernel as K

_U = np.uint64
WINDOW = 5
#: (least, most) characters per token; most byte-fallback share; least normalised token entropy. By language, then
#: by script of most letters, then any. Lower limits and entropy of the four languages lie beside the clean documents of
#: sf0.1 (0.1st percentile of characters per token 1.9-2.3 by language, least entropy 0.45), whose prose is invented:
#: real prose has longer tokens, so upper limits are wider. ODD byte-fallback tokens are free in any text, so that one odd
#: character does not reject a short one; the other limits hold for every text.
BANDS = {
    "en": (2.2, 12.0, 0.10, 0.42),
    "de": (2.2, 12.0, 0.20, 0.42),
    "fr": (2.1, 12.0, 0.20, 0.42),
    "es": (2.1, 12.0, 0.20, 0.42),
    "latin": (2.1, 12.0, 0.25, 0.42),
    "greek": (0.6, 8.0, 0.80, 0.25),
    "cyrillic": (0.8, 10.0, 0.60, 0.25),
    "cjk": (0.3, 4.0, 0.95, 0.25),
    "any": (0.3, 12.0, 0.95, 0.25),
}
ODD = 5
#: White space as the pattern of the vocabulary has it; runs of so many characters are encoded apart (Fertility.tokens).
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
SCRIPTS = ("latin", "greek", "cyrillic", "cjk", "any")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Script by the lead byte of a letter's UTF-8 form.
SCRIPT = np.full(256, 5, np.uint8)
SCRIPT[65:91] = SCRIPT[97:123] = 0
SCRIPT[0xC3:0xCB] = 0
SCRIPT[0xCE:0xD0] = 1
SCRIPT[0xD0:0xD4] = 2
SCRIPT[0xE3:0xEE] = 3
SCRIPT[0xD4:0xE3] = SCRIPT[0xEE:0xF5] = 4


def repeated_words(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and those inside a window of ``size`` words that the row has twice or more."""
    words, ranges = K.word_hashes(data, offsets, K.AS_IS)
    h, at = K.windows(words, ranges, size)
    n = np.diff(ranges)
    if not len(h):
        return n, np.zeros(len(n), np.int64)
    row = np.repeat(np.arange(len(n)), np.diff(at))
    key = K.mix(h + row.astype(_U) * K.STEP[40])
    order = np.argsort(key)
    s = key[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= s[1:] == s[:-1]
    hit = np.flatnonzero(twin)
    place = order[hit] - at[row[order[hit]]] + ranges[row[order[hit]]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    return n, K.per_row(np.cumsum(edge[:-1]) > 0, ranges)


class Fertility:
    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.partial = np.zeros(max(table.values()) + 1, bool)
        for token, rank in table.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.partial[rank] = True

    def tokens(self, text: str) -> np.ndarray:
        """Token ids of a whole text. Matching a run of white space takes time by its square, so what the pattern makes of a
        long one is given to the encoder as it is: all of it at the end of a text, else all but its last character."""
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), self.encoding._encode_single_piece(text[run.start() : end])]
            at = end
        return np.concatenate([*parts, self.encoding.encode_to_numpy(text[at:], disallowed_special=())]).astype(np.int64)

    def __call__(self, text: str) -> tuple[int, int, float]:
        """Tokens, tokens that are no whole characters, entropy in bits over its greatest value for as many tokens."""
        ids = self.tokens(text)
        n = len(ids)
        if n < 2:
            return n, int(self.partial[ids].sum()), 1.0
        s = np.sort(ids)
        c = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))) / n
        return n, int(self.partial[ids].sum()), float(-(c * np.log2(c)).sum() / np.log2(n)) + 0.0


def band(lang: str | None, script: str) -> tuple[float, float, float, float]:
    return BANDS.get(lang or "") or BANDS[script]


def _measure(ranks: str, text_col: str, lang_col: str | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(ranks)
        for batch, data, offsets in K.rows(batches, text_col):
            n = len(offsets) - 1
            n_words, n_repeat = repeated_words(data, offsets)
            chars = K.per_row((data & 0xC0) != 0x80, offsets)
            blanks = K.per_row(K.SPACE[data], offsets)
            symbols = K.per_row(SYMBOL[data], offsets)
            letters = np.stack([K.per_row(SCRIPT[data] == k, offsets) for k in range(len(SCRIPTS))])
            scripts = np.where(letters.any(axis=0), letters.argmax(axis=0), SCRIPTS.index("any"))
            dup, tokens, partial, entropy = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = raw[a:b]
                lines = [x for x in text.split(b"\n") if x.strip()]
                dup[i] = len(lines) - len(set(lines))
                tokens[i], partial[i], entropy[i] = fertility(text.decode())
            per, share = chars / np.maximum(tokens, 1), partial / np.maximum(tokens, 1)
            langs = batch.column(batch.schema.get_field_index(lang_col)).to_pylist() if lang_col else [None] * n
            low, high, most, least = np.array([band(x, SCRIPTS[s]) for x, s in zip(langs, scripts)]).reshape(-1, 4).T
            odd = (per < low) | (per > high) | (partial > most * tokens + ODD) | (entropy < least)
            failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
            made = [n_words, chars - blanks, symbols, dup, n_repeat, failed, ~failed & ~odd, tokens, per, share, entropy]
            yield pa.record_batch(list(batch.columns) + [pa.array(x) for x in made], names)

    return run


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double"}


def quality_rules(docs: DataFrame, ranks: str, *, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs with the measures above, each prefixed q_, of every whole text.

    Null and empty texts have no words, fail the base rule and are not kept. An unknown or null language takes the
    band of the script of most letters, a text without letters the band "any". Repeated rows are
    measured alike; other columns pass through.
    """
    from pyspark.sql.types import StructType

    names = docs.columns + [f"q_{x}" for x in MEASURES]
    kind = StructType(docs.schema.fields + [f for f in StructType.fromDDL(", ".join(f"q_{k} {v}" for k, v in MEASURES.items())).fields])
    return docs.mapInArrow(_measure(ranks, text_col, lang_col, names), kind)


def op9_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, P.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", *(F.col(f"q_{x}").alias(x) for x in MEASURES))
