"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A step reads the UTF-8 bytes of one letter together: each byte brings its own vector for its place among them, so a
letter of any script is one step, letters whose first bytes agree share these, and no script is named anywhere. Case is
dropped, and what is no letter or mark is one blank. The network reads chunks of fixed length in both directions and
gives each position the probabilities of the languages.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

CHUNK = 64
BLANK = 0
PLACES = 4  # bytes of a letter in UTF-8, at most
_POINTS = 0x110000
# Whether a code point is a letter or mark, worked out when first met: 2 is not yet known.
_LETTER = np.full(_POINTS, 2, np.uint8)


def to_bytes(text: str) -> np.ndarray:
    """The letters of a text without case, each a code point that stands for its bytes; runs of others as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _LETTER[points]
    if (known == 2).any():
        for p in np.unique(points[known == 2]):
            _LETTER[p] = unicodedata.category(chr(p))[0] in "LM"
        known = _LETTER[points]
    keep = known == 1
    codes = np.where(keep, points, BLANK).astype(np.uint32)
    keep = keep.copy()
    keep[1:] |= codes[:-1] != BLANK
    return codes[keep]


def to_chunks(codes: np.ndarray) -> np.ndarray:
    """Rows of CHUNK codes; the last is filled by blanks. A text shorter than two chunks may have a single row."""
    n = max(1, -(-len(codes) // CHUNK))
    out = np.zeros(n * CHUNK, np.uint32)
    out[: len(codes)] = codes
    return out.reshape(n, CHUNK)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by a rational function that needs no exponential: monotone, between 0 and 1."""
    d = np.abs(x)
    d += 1
    np.divide(x, d, out=x)
    x *= 0.5
    x += 0.5
    return x


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += 1
    np.divide(x, d, out=x)
    return x


class ByteGru:
    """Weights for both directions: ``x`` (bytes by place to gates), ``u`` (state to gates), ``v``, ``c`` to languages.

    Gates use rational squashing, s(x) = x / (1 + |x|), in place of logistic and hyperbolic tangent; the recurrence is
    that of a gated recurrent unit.
    """

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = list(languages), hidden
        h, f32 = hidden, np.float32
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((PLACES * 256, 3 * h)) * 0.5).astype(f32)
            self.w[f"u{d}"] = (rng.standard_normal((h, 3 * h)) * (0.8 / np.sqrt(h))).astype(f32)
        self.w["v"] = (rng.standard_normal((2 * h, len(languages))) * 0.3).astype(f32)
        self.w["c"] = np.zeros(len(languages), f32)
        self._read = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_read": None}

    @staticmethod
    def letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct letters of coded texts as rows of ``x`` (-1 where a letter has fewer bytes), and each one's place."""
        found, at = np.unique(codes, return_inverse=True)
        rows = np.full((len(found), PLACES), -1, np.int64)
        for i, p in enumerate(found):
            own = chr(p).encode("utf-8", "surrogatepass")
            rows[i, : len(own)] = [256 * k + b for k, b in enumerate(own)]
        return rows, at.reshape(codes.shape)

    def _summed(self, rows: np.ndarray, d: str) -> np.ndarray:
        """Per letter the sum of its bytes' vectors."""
        return (self.w[f"x{d}"][rows] * (rows >= 0)[:, :, None].astype(np.float32)).sum(axis=1)

    def _known(self, codes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Codes as columns of a table of summed vectors that grows as letters are met, and the table per direction."""
        if self._read is None:
            self._read = (np.full(_POINTS, -1, np.int32), {d: np.empty((3 * self.hidden, 0), np.float32) for d in "fb"})
        slot, tables = self._read
        at = slot[codes]
        if (at < 0).any():
            fresh = np.unique(codes[at < 0])
            rows, _ = self.letters(fresh)
            slot[fresh] = tables["f"].shape[1] + np.arange(len(fresh))
            for d in "fb":
                tables[d] = np.ascontiguousarray(np.hstack([tables[d], self._summed(rows, d).T]))
            at = slot[codes]
        return at, tables

    def _run(self, chunks: np.ndarray, d: str, keep: list | None = None, read: tuple | None = None) -> np.ndarray:
        """States of a direction; ``read`` is what ``letters`` gives for the chunks."""
        h = self.hidden
        rows, chunks = read or self.letters(chunks)
        x, u = self._summed(rows, d), self.w[f"u{d}"]
        state = np.zeros((len(chunks), h), np.float32)
        out = np.empty((chunks.shape[1], len(chunks), h), np.float32)
        steps = range(chunks.shape[1]) if d == "f" else range(chunks.shape[1] - 1, -1, -1)
        by_step = np.ascontiguousarray(chunks.T)
        for t in steps:
            a = x[by_step[t]]
            g = state @ u
            a[:, : 2 * h] += g[:, : 2 * h]
            gates = _sigmoid(a[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            gn = g[:, 2 * h :]
            n = a[:, 2 * h :]
            n += r * gn
            n = _squash(n)
            if keep is not None:
                keep.append((t, state, gates.copy(), gn.copy(), n.copy()))
            state = n + z * (state - n)
            out[t] = state
        return out

    def position_scores(self, chunks: np.ndarray) -> np.ndarray:
        """Scores before the softmax, (steps, chunks, languages)."""
        h = self.hidden
        v = self.w["v"]
        return self._run(chunks, "f") @ v[:h] + self._run(chunks, "b") @ v[h:] + self.w["c"]

    def _states(self, codes: np.ndarray, x: np.ndarray, d: str):
        """(step, state) in the order of a direction; states are (hidden, chunks), so that each gate is one stretch of
        memory. The same recurrence as ``_run``, in buffers that are used again."""
        h, (steps, m) = self.hidden, codes.shape
        u = np.ascontiguousarray(self.w[f"u{d}"].T)
        a, g, spare = (np.empty((3 * h, m), np.float32) for _ in range(3))
        state = np.zeros((h, m), np.float32)
        gates, room, n, room_n = a[: 2 * h], spare[: 2 * h], a[2 * h :], spare[2 * h :]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, codes[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            gates += g[: 2 * h]
            np.abs(gates, out=room)
            room += 1
            gates /= room
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[h:], g[2 * h :], out=room_n)
            n += room_n
            np.abs(n, out=room_n)
            room_n += 1
            n /= room_n
            state -= n
            state *= gates[:h]
            state += n
            yield t, state

    def pooled(self, chunks: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk the sum of its letters' probabilities of each language, and the number of its letters."""
        h, n_langs = self.hidden, len(self.languages)
        vf, vb = np.ascontiguousarray(self.w["v"][:h].T), np.ascontiguousarray(self.w["v"][h:].T)
        c = self.w["c"][:, None]
        sums, letters = np.zeros((len(chunks), n_langs), np.float32), (chunks != BLANK).sum(axis=1)
        for at in range(0, len(chunks), block):
            mask = np.ascontiguousarray(chunks[at : at + block].T) != BLANK
            codes, tables = self._known(np.ascontiguousarray(chunks[at : at + block].T))
            scores = np.empty((codes.shape[0], n_langs, codes.shape[1]), np.float32)
            for t, state in self._states(codes, tables["f"], "f"):
                np.matmul(vf, state, out=scores[t])
            total, more = np.zeros(scores.shape[1:], np.float32), np.empty(scores.shape[1:], np.float32)
            for t, state in self._states(codes, tables["b"], "b"):
                s = scores[t]
                s += np.matmul(vb, state, out=more)
                s += c
                s -= s.max(axis=0)
                np.exp(s, out=s)
                s *= mask[t] / s.sum(axis=0)
                total += s
            sums[at : at + block] = total.T
        return sums, letters

    def gradients(self, chunks: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per letter and the gradients of all weights, by backpropagation through time."""
        h, w = self.hidden, self.w
        kept = {"f": [], "b": []}
        letters, places = self.letters(chunks)
        out = {d: self._run(chunks, d, kept[d], (letters, places)) for d in "fb"}
        s = out["f"] @ w["v"][:h] + out["b"] @ w["v"][h:] + w["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        mask = (chunks.T != BLANK).astype(np.float32)
        total = max(1.0, float(mask.sum()))
        rows = np.arange(len(chunks))
        loss = float(-(np.log(s[:, rows, labels] + 1e-9) * mask).sum() / total)
        ds = s
        ds[:, rows, labels] -= 1
        ds *= (mask / total)[:, :, None]
        flat = ds.reshape(-1, ds.shape[2])
        codes = places.T.reshape(-1)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        grads = {"c": flat.sum(axis=0), "v": np.vstack([out[d].reshape(-1, h).T @ flat for d in "fb"])}
        for d, part in (("f", w["v"][:h]), ("b", w["v"][h:])):
            dout = ds @ part.T
            u = w[f"u{d}"]
            du, carried = np.zeros_like(u), np.zeros((len(chunks), h), np.float32)
            da = np.empty((len(kept[d]), len(chunks), 3 * h), np.float32)
            for t, state, gates, gn, n in reversed(kept[d]):
                z, r = gates[:, :h], gates[:, h:]
                dh = dout[t] + carried
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                a = da[t]
                # The slope of the rational sigmoid, from its value.
                a[:, :h] = dh * (state - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                a[:, h : 2 * h] = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                a[:, 2 * h :] = dn
                dg = a.copy()
                dg[:, 2 * h :] *= r
                du += state.T @ dg
                carried = dh * z + dg @ u.T
            grads[f"u{d}"] = du
            # Summed by letter, then by the bytes letters share.
            by_letter = np.add.reduceat(da.reshape(-1, 3 * h)[order], starts, axis=0)
            grads[f"x{d}"] = np.zeros_like(w[f"x{d}"])
            for k in range(PLACES):
                has = letters[:, k] >= 0
                np.add.at(grads[f"x{d}"], letters[has, k], by_letter[has])
        return loss, grads

    def train(self, chunks: np.ndarray, labels: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam with a falling rate over shuffled batches."""
        self._read = None
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        q = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(chunks))])
            at, order = order[:batch], order[batch:]
            _, grads = self.gradients(chunks[at], labels[at])
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                q[k] += 0.01 * (g * g - q[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def paragraphs(text: str) -> list[str]:
    """The parts between blank lines."""
    return [p for p in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n\s*\r\n", text) if p.strip()]
