"""Plain forms of the palette and outline rules, one image at a time, for the tests."""

import re

import numpy as np

from stitchyard.operators.stitch import dst_delta


def lab(rgb):
    v = np.asarray(rgb, float) / 255
    lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = lin @ np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]).T / [0.95047, 1, 1.08883]
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def merge_near(colors, limit):
    out = [[*map(float, c), 1.0] for c in colors]
    while True:
        changed = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                if out[i] and out[j] and ((lab(out[i][:3]) - lab(out[j][:3])) ** 2).sum() <= limit:
                    n = out[i][3] + out[j][3]
                    out[i] = [(a * out[i][3] + b * out[j][3]) / n for a, b in zip(out[i][:3], out[j][:3])] + [n]
                    out[j], changed = None, True
        if not changed:
            return [c[:3] for c in out if c]


def lloyd(px, centers, rounds, still):
    labs, c = lab(px), np.array(centers, float)
    for _ in range(rounds):
        k = ((labs[:, None] - lab(c)[None]) ** 2).sum(-1).argmin(1)
        new = np.array([px[k == i].mean(0) if (k == i).any() else c[i] for i in range(len(c))])
        moved = (np.abs(new - c).sum(1) > still).any()
        c = new
        if not moved:
            break
    return c


def kmeans(px, k, rounds):
    labs, at = lab(px), [0]
    for c in range(1, k):
        d = ((labs[:, None] - labs[at][None]) ** 2).sum(-1).min(1)
        if d.sum() <= 0:
            break
        at.append(int(np.argmax(np.cumsum(d) >= d.sum() * (c * 9973 % 10000 / 10000))))
    return merge_near(lloyd(px, px[at], rounds, 0.35), 36)


def picture(i):
    w, h = 24 + i % 17, 20 + i % 13
    y, x = np.divmod(np.arange(w * h), w)
    return np.stack([(x * 9 + y * 5 + i * 31) % 256, (x * 3 + y * 11 + i * 17) % 256, (x * x + y * 7 + i * 5) % 256], -1).astype(float)


def dst_bytes(kinds: list[str], xs: list[int], ys: list[int]) -> bytes:
    """The body of a DST file, y upwards: longer moves are split, a trim is three jumps; trims and colours stand still."""
    x = y = 0
    out = []
    for kind, a, b in zip(kinds, xs, ys, strict=True):
        if kind == "color":
            out.append(dst_delta(0, 0, stop=True))
        elif kind == "trim":
            out += [dst_delta(-2, 2, True), dst_delta(4, -4, True), dst_delta(-2, 2, True)]
        elif kind != "end":
            dx, dy = a - x, y - b
            while True:
                mx, my = max(-121, min(121, dx)), max(-121, min(121, dy))
                out.append(dst_delta(mx, my, jump=kind == "jump"))
                dx, dy = dx - mx, dy - my
                if not dx and not dy:
                    break
            x, y = a, b
    return b"".join([*out, b"\x00\x00\xf3"])


def dst_header(name: str, kinds: list[str], xs: list[int], ys: list[int]) -> bytes:
    """The 512 bytes before the body: name, counts of stitches and colours, extents around the start."""
    still = {"color", "trim", "end"}
    at = [(0, 0), *((a, b) for k, a, b in zip(kinds, xs, ys, strict=True) if k not in still)]
    number = lambda n, width: str(abs(n)).rjust(7)[-width:]
    parts = ["LA:" + re.sub(r"[^\x20-\x7E]", " ", name or "DESIGN")[:16].ljust(16)]
    parts += ["ST:" + number(sum(k not in still and k != "jump" for k in kinds), 7), "CO:" + number(kinds.count("color"), 3)]
    for axis, i in (("X", 0), ("Y", 1)):
        parts += [f"+{axis}:" + number(max(p[i] for p in at), 5), f"-{axis}:" + number(min(p[i] for p in at), 5)]
    parts += [f"{k}:+" + number(0, 6) for k in ("AX", "AY", "MX", "MY")] + ["PD:******"]
    return ("\r".join(parts) + "\r").encode("ascii").ljust(511) + b"\x1a"
