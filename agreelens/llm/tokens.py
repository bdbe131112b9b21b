"""Token ids exactly as the library gives them, at several times its speed.

The vocabulary's rules never join text across white space, so ids of a text are the ids of its pieces.
Pieces of plain Latin text are found here with the rule of the vocabulary file and encoded once per
task; a chunk with any other character is cut where the library's own pieces begin, and these go to the library.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

# Printable ASCII, white space and the precomposed letters of Latin-1. In this range
# normalisation is lower-casing alone.
PLAIN = re.compile("[\x09-\x0d\x20-\x7eÀ-ÿ]*")
# Fixed pattern of the vocabulary file, for lower-cased text in that range.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+")
CHUNK = re.compile("[^\x09-\x0d\x20]+")
RAW = "\0"
#: Pieces of more characters than this have places inside in the table of prefixes.
LONG_PIECE = 64


def may_compose(letter: str) -> bool:
    """Whether normalisation may join a character to those before it: marks, and Hangul vowels and finals."""
    return unicodedata.category(letter)[0] == "M" or "\u1160" <= letter <= "\u11ff"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTokenizer:
    """Encodes batches of texts; remembers the ids of up to ``limit`` distinct pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        self.whole = Tokenizer.from_file(path)
        self.by_word = Tokenizer(self.whole.model)
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cuts_of: dict[str, list[int]] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def cuts(self, chunk: str) -> list[int]:
        """Ends of the pieces of a chunk beyond plain Latin, by the library's words and their places in the chunk."""
        if chunk not in self.cuts_of:
            encoded = self.whole.encode(chunk, add_special_tokens=False)
            cuts, word, reached = [], None, 0
            for own, (start, end) in zip(encoded.word_ids, encoded.offsets):
                # No cut in a character that gives two pieces, nor before one that changes what stands before it.
                if own != word and start >= max(reached, 1) and not may_compose(chunk[start]):
                    cuts.append(start)
                word, reached = own, max(reached, end)
            self.cuts_of[chunk] = [*cuts, len(chunk)]
        return self.cuts_of[chunk]

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return PIECE.findall(text.lower())
        out: list[str] = []
        for chunk in CHUNK.findall(text):
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                out += PIECE.findall(chunk.lower())
            else:
                cuts = self.cuts(chunk)
                out += [RAW + chunk[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def ends(self, text: str) -> list[int]:
        """Character offset behind each of ``pieces(text)``."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return [m.end() for m in PIECE.finditer(text.lower())]
        out: list[int] = []
        for m in CHUNK.finditer(text):
            chunk = m[0]
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                out += [m.start() + p.end() for p in PIECE.finditer(chunk.lower())]
            else:
                out += [m.start() + c for c in self.cuts(chunk)]
        return out

    def learn(self, new: list[str]) -> None:
        """Ids of pieces not seen before, appended in the order in which they were numbered."""
        plain = [w for w in new if w[0] != RAW]
        mapped = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in plain]
        joined = [" ".join(mapped[i : i + 500]) for i in range(0, len(mapped), 500)]
        flat = [np.array(e.ids, np.int32) for e in self.by_word.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        # Each plain piece ends with the one token that closes a word.
        lengths = np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)
        if len(lengths) != len(plain):
            raise ValueError("a piece has no single closing token")
        if len(plain) < len(new):
            raw = [w[1:] for w in new if w[0] == RAW]
            parts = iter([np.array(e.ids, np.int32) for e in self.whole.encode_batch(raw, add_special_tokens=False)])
            plains = iter(np.split(ids, np.cumsum(lengths)[:-1]))
            ordered = [next(parts) if w[0] == RAW else next(plains) for w in new]
            lengths = np.array([len(x) for x in ordered], np.int64)
            ids = np.concatenate(ordered)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])

    def index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of all texts, and where each text begins among them."""
        if len(self.known) > self.limit or len(self.cuts_of) > self.limit:
            self.forget()
        known, new, parts = self.known, [], []
        for text in texts:
            pieces = self.pieces(text)
            for w in set(pieces).difference(known):
                known[w] = len(known)
                new.append(w)
            parts.append(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
        if new:
            self.learn(new)
        bounds = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text begins in it."""
        index, bounds = self.index(texts)
        lengths = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[index] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[at], ends[bounds]

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token count of every prefix that ends with a piece; the last is the text's count."""
        index, bounds = self.index(texts)
        # count[i + 1] = count[i] + tokens of piece i: exact, as no token crosses a piece.
        total = np.cumsum(self.lengths[index])
        before = np.concatenate([[0], total])[bounds]
        return [total[a:b] - c for a, b, c in zip(bounds[:-1], bounds[1:], before[:-1])]

    def count_prefix(self, text: str, chars: int, ends: list[int], counts: np.ndarray) -> int:
        """Tokens of ``text[:chars]`` from stored counts; at most one piece is encoded."""
        i = int(np.searchsorted(ends, chars, "right"))
        start = ends[i - 1] if i else 0
        rest = text[start:chars]
        tail = len(self.whole.encode(rest, add_special_tokens=False).ids) if rest.strip() else 0
        return (int(counts[i - 1]) if i else 0) + tail


    def fitting(self, text: str, limit: int, ends: list[int], counts: np.ndarray) -> int:
        """Characters of ``text``, of more than ``limit`` tokens, up to the last piece that fits, and on inside a long piece."""
        i = int(np.searchsorted(counts, limit, "right"))
        low, high = ends[i - 1] if i else 0, ends[i]
        if high - low > LONG_PIECE:
            # ``low`` fits and ``high`` does not, at every step.
            while high - low > 1:
                middle = (low + high) // 2
                fits = self.count_prefix(text, middle, ends, counts) <= limit
                low, high = (middle, high) if fits else (low, middle)
        return low

    def with_inside(self, text: str, ends: list[int], counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The table with up to 64 evenly spaced places inside each long piece; counts do not fall along it."""
        all_ends, all_counts = [], []
        for i, end in enumerate(ends):
            start, count = (ends[i - 1], int(counts[i - 1])) if i else (0, 0)
            if end - start > LONG_PIECE:
                for chars in range(start + max(32, (end - start) // 64), end, max(32, (end - start) // 64)):
                    own = self.count_prefix(text, chars, ends, counts)
                    if count <= own <= counts[i]:
                        all_ends.append(chars)
                        all_counts.append(count := own)
            all_ends.append(end)
            all_counts.append(int(counts[i]))
        return all_ends, np.array(all_counts, np.int64)


def worker_tokenizer(path: str) -> PieceTokenizer:
    """A tokenizer for one task, single-threaded: the task owns one core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceTokenizer(path)
