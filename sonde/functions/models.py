"""Heads over a pluggable language model: token vectors, vocabulary activations, and vectors of activated terms.

A model is any object with ``forward(texts, length)``: logits (text, place, term), last hidden states (text, place, dim) and mask
(text, place; 0: padding), each text cut or padded to ``length`` places, and ``mask_token``. It is made once per Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np


class Model(Protocol):
    mask_token: str

    def forward(self, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


@dataclass
class SineModel:
    """A fixed model without weights, to test heads and plans: all it gives is sines of a word's number and place.

    The number of a word is (7 * its first code point + 13 * its length) mod ``terms``.
    """

    terms: int = 32
    dim: int = 6
    mask_token: str = "[MASK]"

    def forward(self, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = np.zeros((len(texts), length))
        mask = np.zeros((len(texts), length))
        for i, text in enumerate(texts):
            words = text.split()[:length]
            number[i, : len(words)] = [(7 * ord(w[0]) + 13 * len(w)) % self.terms + 1 for w in words]
            mask[i, : len(words)] = 1
        place = np.arange(length)[None, :, None]
        logits = 4 * np.sin(number[:, :, None] * (np.arange(self.terms) + 1) / 2 + place)
        return logits, np.sin(number[:, :, None] * (np.arange(self.dim) + 1) + place), mask


def cosines(rows: int, columns: int) -> np.ndarray:
    """A fixed projection, to test heads."""
    return np.cos(np.outer(np.arange(rows) + 1, np.arange(columns) + 2))


@dataclass
class TokenVectors:
    """A text as a unit vector for each place: the projected hidden states; places of padding are zero vectors.

    So a document with padding lets no query vector score below 0.
    """

    model: Model
    linear: np.ndarray
    length: int = 256
    prefix: str = "[D] "

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        _, hidden, mask = self.model.forward([self.prefix + t for t in texts], self.length)
        out = (hidden * mask[:, :, None]) @ self.linear
        norm = np.linalg.norm(out, axis=2, keepdims=True)
        return list(out / np.where(norm > 0, norm, 1))


@dataclass
class Activations:
    """A text as its ``length`` strongest vocabulary terms: the largest ln(1 + relu(logit)) over the places, ties by term."""

    model: Model
    length: int = 256
    prefix: str = ""
    n_masks: int = 3
    top: int | None = None

    def states(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        masks = " ".join([self.model.mask_token] * self.n_masks)
        logits, hidden, mask = self.model.forward([f"{self.prefix}{t} {masks}" for t in texts], self.length)
        logits, hidden = logits * mask[:, :, None], hidden * mask[:, :, None]
        value = np.log1p(np.maximum(logits, 0)).max(axis=1)
        terms = np.argsort(-value, axis=1, kind="stable")[:, : self.top or self.length]
        return terms, np.take_along_axis(value, terms, 1), logits, hidden

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        terms, value, _, _ = self.states(texts)
        return list(zip(terms, value, strict=True))


@dataclass
class EmbeddedActivations(Activations):
    """As ``Activations``, with a vector for each term: the hidden states by the softmax over a place's activated terms, projected, relu."""

    linear: np.ndarray | None = None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        terms, value, logits, hidden = self.states(texts)
        at = np.take_along_axis(logits, np.repeat(terms[:, None, :], logits.shape[1], axis=1), 2)
        weight = np.exp(at - at.max(axis=2, keepdims=True))
        weight /= weight.sum(axis=2, keepdims=True)
        mixed = np.swapaxes(weight, 1, 2) @ hidden
        return list(zip(terms, value, np.maximum(mixed if self.linear is None else mixed @ self.linear, 0), strict=True))


def freeze(model, n_last: int = 5) -> None:
    """Let only the last ``n_last`` parameter tensors of a model with ``parameters()`` be trained."""
    every = list(model.parameters())
    for p in every[: max(0, len(every) - n_last)]:
        p.requires_grad = False
