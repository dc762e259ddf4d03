"""Token ids of a public byte-level BPE vocabulary (a tokenizers JSON file)."""

from __future__ import annotations

import json

import numpy as np


class ByteBpe:
    """The ids that the ``tokenizers`` library gives with ``add_special_tokens=False``.

    The vocabulary of the file is handed to tiktoken, which applies the same
    merges several times faster.  Texts that hold the string of a special token
    go to the ``tokenizers`` library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte = _byte_of_letter()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def fragments(self) -> np.ndarray:
        """By id: 1 for tokens that are not whole characters by themselves."""
        out = np.zeros(self.whole.get_vocab_size(), np.uint8)
        for i in range(len(out)):
            try:
                self.fast.decode_single_token_bytes(i).decode()
            except UnicodeDecodeError:
                out[i] = 1
            except KeyError:  # a special token
                pass
        return out

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
