"""Exact token ids of the tokenizers library, with a memo of the pieces seen before.

Both vocabularies split a text before any merging. A space after a character and before one that is no
white space is always such a split, so the ids of a text are those of its pieces one after the other.
A text with white space right after a space goes to the library whole, unless white space is dropped.
"""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np

from .common import chunks

#: Pieces remembered by a worker; beyond it the memo starts anew, so its memory is bounded (about 200 bytes a piece).
MEMO = 300_000
#: A text with a longer piece goes to the library whole, so no long piece is remembered.
LONG_PIECE = 200
#: Characters looked up together; small, so that what is at hand fits the processor's cache.
RUN = 25_000
_LOADED: dict[str, Encoder] = {}
#: How byte vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip(sorted({*range(256)} - {*_PRINTED}), range(256, 512)))  # noqa: B905


def encoder(path: str, words_only: bool, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a vocabulary file; made once a process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, words_only, memo)
    _LOADED[path].most = memo
    return _LOADED[path]


class Encoder:
    """words_only: the vocabulary drops white space (else a piece keeps the space before it)."""

    def __init__(self, path: str, words_only: bool, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words_only, self.model = words_only, self.tokenizer.model
        self.most = memo
        self.memo: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        #: Of each id whether it ends a word, and how many bytes of text it stands for.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.width = np.zeros(len(self.ends), np.int64)
        for token, i in vocab.items():
            self.ends[i], self.width[i] = token.endswith("</w>"), len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def alone(self, words: list[str]) -> list[bytes]:
        """The same for pieces of letters alone (after a space, unless white space is dropped): each is one split, so it
        goes straight to the merges. Where white space is dropped only ASCII does; other words may be changed before."""
        if self.words_only and not all(map(str.isascii, words)):
            plain = [w for w in words if w.isascii()]
            others = [w for w in words if not w.isascii()]
            found = dict(zip(plain, self.alone(plain), strict=True)) | dict(zip(others, self.joined(others), strict=True))
            return [found[w] for w in words]
        merge, ids, ends = self.model.tokenize, [], [0]
        for word in map(str.lower, words) if self.words_only else [w.encode().decode("latin-1").translate(_SHOWN) for w in words]:
            ids += [x.id for x in merge(word)]
            ends.append(4 * len(ids))
        raw = np.array(ids, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def joined(self, words: list[str]) -> list[bytes]:
        """The same as one text that the library splits itself."""
        if not words:
            return []
        text = " ".join(words) if self.words_only else "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        if self.words_only:
            cuts = np.flatnonzero(self.ends[ids]) + 1
        else:
            upto = np.cumsum([len(w.encode()) for w in words])
            run = np.cumsum(self.width[ids])
            cuts = np.searchsorted(run, upto) + 1
            if len(run) != cuts[-1] or (run[cuts - 1] != upto).any():
                return self.whole(words)
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self.whole(words)
        raw, ends = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pieces(self, text: str) -> list[str]:
        if self.words_only:
            # Lower case is the vocabulary's own first step; for ASCII it is the same here.
            text = text.lower() if text.isascii() else text
            return text.replace("\n", " ").split(" ")
        if "\0" in text or "\n\n" in text:
            return [text]
        # A line end between characters that are no white space is a split of its own.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def apart(self, piece: str) -> bool:
        """Whether a piece's ids don't depend on its neighbours."""
        if self.words_only or piece in ("", "\n"):
            return len(piece) <= LONG_PIECE
        core = piece.removeprefix(" ")
        return 0 < len(core) and len(piece) <= LONG_PIECE and not core[0].isspace() and not core[-1].isspace()

    def learn(self, pieces: set[str]) -> set[str]:
        """Puts pieces into the memo; returns those whose ids may depend on their neighbours, which aren't put there.
        Letters before trailing punctuation are a split of their own."""
        memo, words, other, later, odd = self.memo, set(), set(), [], set()
        punctuation, words_only = string.punctuation, self.words_only
        for piece in pieces:
            core = piece.rstrip(punctuation)
            if len(piece) > LONG_PIECE or not (core.lower().isalpha() if words_only else core[:1] == " " and core[1:].isalpha()):
                (other if self.apart(piece) else odd).add(piece)
            elif len(core) == len(piece):
                words.add(piece)
            else:
                end = piece[len(core) :]
                later.append((piece, core, end))
                words.add(core)
                other.add(end)
        new = [x for x in words if x not in memo]
        memo.update(zip(new, self.alone(new), strict=True))
        new = [x for x in other if x not in memo]
        memo.update(zip(new, self.whole(new), strict=True))
        memo.update([(piece, memo[core] + memo[end]) for piece, core, end in later])
        return odd

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; None is an empty text."""
        out: list[bytes] = []
        for _, some in chunks(texts, RUN):
            lists = [self.pieces(x) for x in some]
            every = list(chain.from_iterable(lists))
            if len(self.memo) > self.most:
                self.memo.clear()
            found = list(map(self.memo.get, every))
            missing, at = [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                missing.append(at)
            odd = self.learn({every[i] for i in missing})
            for i in missing:
                found[i] = self.memo.get(every[i], b"")
            at = 0
            for text, pieces in zip(some, lists, strict=True):
                out.append(self.whole([text])[0] if odd and not odd.isdisjoint(pieces) else b"".join(found[at : at + len(pieces)]))
                at += len(pieces)
        return out
