"""Fast, exact token ids of the public vocabulary files.

Both encoders take the ``tokenizers`` JSON file as the truth. Texts of plain Latin
characters go through a rank encoder whose ranks come from that JSON; any other text
(other scripts, special-token strings, unusual controls) is given to ``tokenizers``
itself, so ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|")
_GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE; ``encode`` returns uint32 ids."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in piece): i for piece, i in self.library.get_vocab(with_added_tokens=True).items() if piece not in special}
        self.fast = tiktoken.Encoding("own", pat_str=_GPT_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _PLAIN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


class WordBpe:
    """Lower-case BPE with word ends; ``encode`` returns uint32 ids.

    The rank encoder sees each word with a closing NUL byte that stands for the word-end
    mark; "last byte + NUL" pairs get the lowest ranks, so that they merge first.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, chars, vocab = model["end_of_word_suffix"], _byte_chars(), model["vocab"]
        ids: list[int] = [-1] * 256
        ranks = {bytes([b]): b for b in range(256)}

        def raw(piece: str) -> bytes:
            return bytes(chars[c] for c in piece[: -len(end)]) + b"\0" if piece.endswith(end) else bytes(chars[c] for c in piece)

        for c, b in chars.items():
            ids[b] = vocab[c]
        for c, b in chars.items():
            if (key := bytes([b, 0])) != b"\0\0":
                ranks[key] = len(ids)
                ids.append(vocab[c + end])
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (key := raw(a) + raw(b)) not in ranks and 0 not in key[:-1]:
                ranks[key] = len(ids)
                ids.append(vocab[a + b])
        self.ids = np.array(ids, np.int64).astype(np.uint32)
        self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _PLAIN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        found = _WORD.findall(text.lower())
        if not found:
            return np.zeros(0, np.uint32)
        found.append("")
        return self.ids[np.array(self.fast.encode_ordinary("\0".join(found)), np.int64)]


@lru_cache(maxsize=4)
def encoder(path: str, kind: str):
    """One encoder a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return {"byte": ByteBpe, "word": WordBpe}[kind](path)
