"""BPE by dynamic programming over prefixes.

Every prefix of a word has one encoding, so it has one last token. An automaton over the vocabulary walks the word
once; its suffix links list the tokens that end at each position. Such a token t is the last token of the prefix
exactly if it is compatible with the last token p of the prefix that t leaves, that is, if BPE turns the string of p
and t into (p, t) again. The last tokens are stored as back-pointers, which give the ids from the end of the word.
The cost is linear in the length of a word, whatever the number of merges.
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import computed

CACHED_WORDS = 400_000
CACHED_PAIRS = 1_000_000
# Fixed value: the contractions, letters, digits and other characters that the definition splits words into.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Characters that Python takes for white space and Unicode does not.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_coders: dict[int, "PrefixCoder"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCoder:
    """Encoder and decoder of one definition: byte-level BPE whose last symbol of a word carries a suffix.

    Inside, a word is a string with one character for each byte, and the last character raised by 256.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        letter = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        inner = {letter[b]: chr(b) for b in range(256)} | {letter[b] + suffix: chr(256 + b) for b in range(256)}
        names = dict(inner)
        self.rank: dict[tuple[str, str], tuple[int, str]] = {}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            names[a + b] = names[a] + names[b]
            self.rank.setdefault((names[a], names[b]), (rank, names[a] + names[b]))
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, code in names.items():
            if name in vocabulary and self.merged(code) == [code]:  # a token that its own string does not give is never used
                self.ids[code] = vocabulary[name]
                self.automaton.add_word(code, code)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, str, int]] = {}
        self.by_id = {i: n for n, i in vocabulary.items()} | {i: n for n, i in self.special.items()}

    def merged(self, code: str) -> list[str]:
        """Plain merging by rank, used on single tokens and pairs of tokens only."""
        parts = list(code)
        while len(parts) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            made, out, i = self.rank[pair][1], [], 0
            while i < len(parts):  # all places of the pair, from the left
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(made)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, pair: tuple[str, str]) -> bool:
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(pair[0] + pair[1]) == [*pair]
        return known

    def tokens(self, piece: str) -> list[str]:
        """Tokens of one piece of a word, by back-pointers from its end."""
        raw = piece.encode("utf-8", "surrogatepass")
        code = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last: list[str | None] = [None] * (len(code) + 1)
        for end, token in self.automaton.iter(code):
            if last[end + 1] is None:
                start = end + 1 - len(token)
                before = last[start]
                if start == 0 or (before is not None and self.compatible((before, token))):
                    last[end + 1] = token
        out, at = [], len(code)
        while at:
            token = last[at]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def word(self, word: str) -> tuple[str, str, int]:
        """Ids and token names, each joined by blanks, and their number, of a word between blanks."""
        known = self.words.get(word)
        if known is None:
            found = [t for piece in PIECES.findall(word) for t in self.tokens(piece)]
            ids = [self.ids[t] for t in found]
            known = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            if len(word) < 200:
                self.words[word] = known
        return known

    def split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # lower case by character, without a final form
        text = text.lower()
        return text.split() if SEPARATORS.search(text) is None else [w for w in BLANKS.split(text) if w]

    def encode(self, text: str) -> tuple[list[str], list[str], int]:
        """(id groups, name groups, number of tokens); groups are to be joined by blanks."""
        parts = [text]
        if any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        ids, names, total = [], [], 0
        for i, part in enumerate(parts):
            if i % 2:
                found = [(str(self.special[part]), part, 1)]
            else:
                found = [w for w in map(self.word, self.split(part)) if w[2]]
            for a, b, n in found:
                ids.append(a)
                names.append(b)
                total += n
        return ids, names, total

    def decode(self, ids: list[int]) -> str:
        """Token names joined by blanks: what a definition without a decoder gives. Unknown ids are passed over."""
        return " ".join(self.by_id[i] for i in ids if i in self.by_id)


def coder(definition: str) -> PrefixCoder:
    """One coder for each definition and worker process."""
    key = hash(definition)
    if key not in _coders:
        _coders[key] = PrefixCoder(definition)
    return _coders[key]


def _shared(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size


def encode(df: DataFrame, text: str, tokenizer: str, keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """Append the ids of each whole text as an array; NULL and empty texts and texts of blanks give an empty one.

    ``tokenizer`` is the path of the definition on the driver. Rows are neither dropped nor merged, and a column
    called like the output is replaced.
    """
    shared = _shared(df, tokenizer)

    def make():
        known = coder(shared.value)
        return lambda texts: [[[int(i) for g in known.encode(t or "")[0] for i in g.split(" ")] for t in texts]]

    return computed(df, [text], [T.StructField(name, T.ArrayType(T.LongType()))], make, keep)


def decode(df: DataFrame, ids: str, tokenizer: str, keep: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """Append the text of each array of ids; NULL and empty arrays give the empty text."""
    shared = _shared(df, tokenizer)

    def make():
        known = coder(shared.value)
        return lambda rows: [[known.decode(r or []) for r in rows]]

    return computed(df, [ids], [T.StructField(name, T.StringType())], make, keep)


def digests(df: DataFrame, text: str, tokenizer: str, keep: list[str]) -> DataFrame:
    """Append the number of tokens and the SHA-256 of the ids and of the decoded text, each joined by blanks."""
    shared = _shared(df, tokenizer)

    def make():
        known = coder(shared.value)

        def run(texts):
            count, ids, decoded = [], [], []
            for t in texts:
                a, b, n = known.encode(t or "")
                count.append(n)
                ids.append(sha256(" ".join(a).encode()).hexdigest())
                decoded.append(sha256(" ".join(b).encode()).hexdigest())
            return [count, ids, decoded]

        return run

    return computed(df, [text], [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                                 T.StructField("decoded_sha256", T.StringType())], make, keep)
