"""What a model's raw output becomes: scores selected in numpy, a batch of images at a time.

A model is an image function whose output its architecture tells how to read: `Vit` gives logits of its
classes, `Siglip` embeddings that are compared with those of prompts, and a plain function scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Fixed values of the selection rules.
TOP, CONFIDENT, FLAT_THRESHOLD, TAXONOMY_THRESHOLD = 5, np.float32(0.90), 0.5, 0.0


@dataclass
class Vit:
    """`forward(images)` gives logits (n, classes); their softmax is selected from."""

    forward: Callable


@dataclass
class Siglip:
    """`embed_images(images)` and `embed_texts(texts)` give vectors; a pair scores sigmoid(exp(log_scale) * cosine + bias)."""

    embed_images: Callable
    embed_texts: Callable
    log_scale: float
    bias: float


def ranked(scores: np.ndarray, most: int | None = None, least: float | None = None, sure: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 1) of what is kept of each row, highest first; ties keep column order, NaN comes last.

    Kept are scores of at least `least`, the `most` highest of them, and beyond those all above `sure`.
    A partition finds the lowest that may be kept, so only the survivors are sorted.
    """
    key = np.where(np.isnan(scores), -np.inf, scores)
    keep = np.ones(scores.shape, bool) if least is None else scores >= np.float32(least)
    width = scores.shape[1]
    if most is not None and most < width:
        near = key >= np.partition(key, width - most, axis=1)[:, width - most, None] if most else np.zeros(scores.shape, bool)
        keep &= near if sure is None else near | (scores > sure)
    rows, columns = np.nonzero(keep)
    order = np.lexsort((columns, -key[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
    if most is not None:
        inside = rank <= most if sure is None else (rank <= most) | (scores[rows, columns] > sure)
        rows, columns, rank = rows[inside], columns[inside], rank[inside]
    return rows, columns, rank


def select_top(scores: np.ndarray):
    """The five highest of each row, and all above 0.90."""
    return ranked(scores, TOP, sure=CONFIDENT)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True, initial=-np.inf))
    return (e / e.sum(axis=1, keepdims=True)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths in double precision; a zero vector has no direction: NaN."""
    vectors = np.asarray(vectors, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def sigmoid(cosines: np.ndarray, log_scale: float, bias: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(np.exp(log_scale) * cosines + bias)))


class Children:
    """Prompts pooled by child: per child the mean or the maximum of its own prompts' scores.

    `prompts` lists (prompt_ix, child_id, agg) of each column; children keep the order of their first prompt.
    """

    def __init__(self, prompts: list[tuple[int, int, str | None]]):
        first: dict[int, int] = {}
        for ix, child, _ in prompts:
            first[child] = min(first.get(child, ix), ix)
        self.ids = np.array(sorted(first, key=lambda c: first[c]), np.int64)
        place = {c: i for i, c in enumerate(self.ids.tolist())}
        of = np.array([place[child] for _, child, _ in prompts], np.int64)
        self.order = np.argsort(of, kind="stable")
        self.starts = np.searchsorted(of[self.order], np.arange(len(self.ids)))
        self.sizes = np.bincount(of, minlength=len(self.ids))
        means = {child for _, child, how in prompts if how in ("mean", "average")}
        self.mean = np.array([c in means for c in self.ids.tolist()], bool)
        self.first = np.array([first[c] for c in self.ids.tolist()], np.int64)

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros((len(scores), 0), np.float32)
        scores = scores[:, self.order]
        return np.where(self.mean, np.add.reduceat(scores, self.starts, axis=1) / self.sizes, np.maximum.reduceat(scores, self.starts, axis=1)).astype(np.float32)


def prompt_texts(labels: list[str], template: str | None) -> list[str]:
    """All `{}` of the template replaced, else the template as a prefix, else the labels themselves."""
    if template is None:
        return list(labels)
    return [template.replace("{}", x) if "{}" in template else f"{template} {x}" for x in labels]


def predictor(model, settings: dict | None = None) -> Callable[[list], list[list[tuple[int, float]]]]:
    """images -> a list of (label, score) for each, by the model's kind and its configuration.

    `settings`: architecture, taxonomy (rows as Taxonomy.rows) or prompts (label texts) and template,
    score_threshold, max_results. Prompts are embedded here, once for as long as the model stays loaded.
    A plain function's scores are of classes, or with the architecture `siglip` of prompts.
    """
    settings = settings or {}
    prompted = isinstance(model, Siglip) or settings.get("architecture") == "siglip" and not isinstance(model, Vit)
    taxonomy, threshold = settings.get("taxonomy"), settings.get("score_threshold")
    labels, children = None, None
    if prompted and taxonomy:
        children = Children([(ix, child, how) for ix, _, child, _, how in taxonomy])
        labels = children.ids
        texts = [prompt for _, prompt, _, _, _ in taxonomy]
        choose = lambda s: ranked(s, least=TAXONOMY_THRESHOLD if threshold is None else threshold)
    elif prompted:
        texts = prompt_texts(settings.get("prompts") or [], settings.get("template"))
        if isinstance(model, Siglip) and not texts:
            raise ValueError("siglip models need prompts or a taxonomy")
        choose = lambda s: ranked(s, settings.get("max_results"), FLAT_THRESHOLD if threshold is None else threshold)
    else:
        choose = select_top
    prompts = unit(model.embed_texts(texts)).T if isinstance(model, Siglip) else None

    def predict(images: list) -> list[list[tuple[int, float]]]:
        if isinstance(model, Siglip):
            raw = sigmoid(unit(model.embed_images(images)) @ prompts, model.log_scale, model.bias)
        elif isinstance(model, Vit):
            raw = softmax(np.asarray(model.forward(images), np.float64))
        else:
            raw = np.asarray(model(images))
        if len(raw) != len(images):
            raise ValueError(f"the model gave {len(raw)} rows for {len(images)} images")
        scores = np.asarray(children(raw) if children else raw, np.float32)
        out: list[list[tuple[int, float]]] = [[] for _ in images]
        rows, columns, _ = choose(scores)
        for row, column in zip(rows.tolist(), columns.tolist()):
            out[row].append((int(labels[column]) if labels is not None else column, float(scores[row, column])))
        return out

    return predict
