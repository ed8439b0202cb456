"""Weak supervision: a generative model of voters, and a linear scorer trained on its posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, NO, YES = 0, 1, 2
ROUNDS = 50
DEPENDENT = 0.2  # correlation, given the label, from which two voters share their weight


@dataclass(frozen=True)
class VoteModel:
    """``log_p[label, voter, vote]``; ``weight`` is 1 for a voter independent of the others."""

    prior: float
    log_p: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of YES for each row of votes."""
        per = np.take_along_axis((self.log_p[1] - self.log_p[0]), votes.T, axis=1)
        odds = np.log(self.prior / (1 - self.prior)) + self.weight @ per
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """How often each voter is right when it votes."""
        p = np.exp(self.log_p)
        right = (1 - self.prior) * p[0, :, NO] + self.prior * p[1, :, YES]
        cast = right + (1 - self.prior) * p[0, :, YES] + self.prior * p[1, :, NO]
        return right / np.maximum(cast, 1e-12)


def fit_votes(votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, prior: float = 0.1, better: float = 1.0, apart: tuple[int, ...] = (), restarts: int = 0) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    Estimation starts from the odds ``prior`` and the balance of the votes, a NO
    counting for several YES as it is cast more seldom. With ``better`` over 1, a
    vote is that many times likelier, at least, under the label it names.
    ``known`` holds the label (0 or 1) of patterns of labelled rows, or -1.
    Voters are taken as independent given the label; then the correlations that
    this leaves are measured, and a voter's evidence is divided among those it
    moves with, and the model fitted again with these weights. Voters ``apart``
    look at something else than the others do, and share with none. Fits can get
    stuck where copies of one voter outvote the rest; a restart begins again from
    the votes with the weights found.
    """
    counts = counts.astype(float)
    m = votes.shape[1]
    known = np.full(len(votes), -1) if known is None else known
    start = (votes == YES) - (3.0 if better > 1 else 1.0) * (votes == NO)
    weight, corr = np.ones(m), np.eye(m)
    model = VoteModel(prior, np.zeros((2, m, 3)), weight, corr)
    post = 1 / (1 + np.exp(-(start.sum(1) + np.log(prior / (1 - prior)))))
    for attempt in range(2 + restarts):
        if restarts:
            post = 1 / (1 + np.exp(-(start @ weight + np.log(prior / (1 - prior)))))
        for _ in range(ROUNDS):
            post = np.where(known >= 0, known, post)
            by = np.stack([counts * (1 - post), counts * post])
            table = np.stack([np.stack([(by * (votes[:, j] == v)).sum(1) for v in range(3)], 1) for j in range(m)], 1) + 0.5
            log_p = np.log(table / table.sum(2, keepdims=True))
            if better > 1:
                log_p[1, :, NO] = np.minimum(log_p[1, :, NO], log_p[0, :, NO] - np.log(better))
                log_p[0, :, YES] = np.minimum(log_p[0, :, YES], log_p[1, :, YES] - np.log(better))
            model = VoteModel(float(np.clip(by[1].sum() / max(1.0, counts.sum()), 1e-4, 1 - 1e-4)), log_p, weight, corr)
            post = model.posterior(votes)
        if attempt <= restarts:
            says = (votes == YES) * 1.0 - (votes == NO)
            p = np.exp(model.log_p)
            expected = (1 - post)[:, None] * (p[0, :, YES] - p[0, :, NO]) + post[:, None] * (p[1, :, YES] - p[1, :, NO])
            rest = says - expected
            cov = (rest * counts[:, None]).T @ rest
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = cov / scale[:, None] / scale[None, :]
            shared = np.abs(corr) * (np.abs(corr) > DEPENDENT)
            for j in apart:
                shared[j], shared[:, j] = 0, 0
            weight = 1 / np.maximum(1, shared.sum(1))
    return VoteModel(model.prior, model.log_p, weight, corr)


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, importance: np.ndarray, size: int, ridge: float = 1e-4, rounds: int = 150, rate: float = 0.5) -> Linear:
    """Logistic regression on sparse features and soft labels, by Adagrad over all rows."""
    w, b = np.zeros(size), 0.0
    seen, seen_b = np.full(size, 1e-6), 1e-6
    total = max(1e-9, importance.sum())
    for _ in range(rounds):
        z = np.bincount(rows, w[columns] * values, minlength=len(labels)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * importance / total
        grad = np.bincount(columns, error[rows] * values, minlength=size) + ridge * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(seen_b)
    return Linear(w.astype(np.float32), float(b))
