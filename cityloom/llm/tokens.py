"""Token ids of texts with a public tokenizer, as little-endian unsigned 32-bit bytes.

The vocabulary used here works on pieces (letter runs, single digits, runs of other signs): a text's ids are its pieces' ids
one after another. Most pieces recur, so their ids are kept; new ones are encoded by the library, many in one call. Texts
with signs beyond Latin-1, controls or the vocabulary's special strings go to the library whole, since what it does to them
(composition, case of other scripts) is not repeated here.
"""

from __future__ import annotations

import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
KEPT = 400_000
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
# no two kinds begin alike but the endings after an apostrophe and other signs, so the most frequent comes first
PIECE = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")


class Tokens:
    def __init__(self, path: str, whole: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ends = [i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]
        self.last = np.zeros(self.library.get_vocab_size(), bool)  # ids that end a piece
        self.last[ends] = True
        self.kept: dict[str, bytes] = {}
        self.whole = whole

    def of(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, in bytes. Pieces that are new to this batch of texts are learned together."""
        out: list[bytes | None] = [None] * len(texts)
        pieces: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if self.whole or "<|" in text or not PLAIN.fullmatch(text):
                out[i] = self.direct(text)
            else:
                pieces[i] = PIECE.findall(text.lower())
        if len(self.kept) > KEPT:
            self.kept.clear()
        kept = self.kept
        self.learn([p for p in set().union(*pieces.values()) if p not in kept])
        for i, ps in pieces.items():
            out[i] = b"".join(map(kept.__getitem__, ps))
        return out

    def direct(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Ids of pieces. Letter runs are encoded as one text, space between them; others one by one, since they join or split."""
        words = [p for p in new if p.isalpha()]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            got = self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            data = ids.tobytes()
            if len(ends) != len(part):
                raise ValueError("the vocabulary doesn't mark the ends of pieces")
            self.kept.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for p in new:
            if p not in self.kept:
                self.kept[p] = self.direct(p)
