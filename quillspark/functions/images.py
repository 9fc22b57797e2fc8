"""Image kernels on uint8 arrays (grey, or red, green and blue), for use within Arrow-batched functions.

They follow the published definitions of the operations; where those leave roundings or
random choices open, ours are deterministic. The fast-marching inpainting is done layer by
layer from the rim, and colours are clustered from a sample with a fixed seed.
"""

from __future__ import annotations

import numpy as np

#: Settings of the preprocessing and their defaults (fixed values).
DEFAULTS: dict = {
    "rescale_min_dim": 0, "deskew": True, "deskew_max_angle": 20, "clahe_clip_limit": 2.0, "clahe_tile_grid": (8, 8), "denoise_ksize": 0,
    "remove_grid": True, "grid_hsv_lo": (85, 20, 80), "grid_hsv_hi": (125, 160, 255), "grid_min_len_ratio": 0.10, "grid_inpaint_radius": 3,
    "value_threshold": 0.25, "sat_threshold": 0.20, "num_colors": 8, "sample_fraction": 0.05, "morph_op": None, "morph_ksize": 2, "morph_iters": 1,
    "border_px": 10, "alpha_crop": True,
}
#: With these, boxes measured on the input hold on the output.
SAME_GEOMETRY = {"deskew": False, "border_px": 0, "alpha_crop": False}


def composite(rgba: np.ndarray, crop: bool = True) -> np.ndarray:
    """Crop to the rows and columns that are mostly opaque, then lay over white; images without alpha as they are."""
    if rgba.ndim != 3 or rgba.shape[2] != 4:
        return rgba
    if crop:
        solid = rgba[..., 3] > 200
        for axis in (0, 1):
            held = np.flatnonzero(solid.mean(axis=1 - axis) > 0.5)
            if len(held):
                part = slice(held[0], held[-1] + 1)
                rgba = rgba[part] if axis == 0 else rgba[:, part]
    alpha = rgba[..., 3:].astype(np.float32) / np.float32(255)
    return (rgba[..., :3].astype(np.float32) * alpha + np.float32(255) * (1 - alpha)).astype(np.uint8)


def rgb(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue."""
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at t from the second (cubic convolution, a = -0.75)."""
    a = -0.75
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.stack([far(t + 1), near(t), near(1 - t), far(2 - t)], axis=-1)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image at places (y, x) between pixels, its rim going on outside."""
    image = rgb(image).astype(np.float64)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = cubic(y - y0), cubic(x - x0)
    out = np.zeros((*y.shape, 3))
    for i in range(4):
        row = np.clip(y0 + i - 1, 0, image.shape[0] - 1)
        for j in range(4):
            out += (wy[..., i] * wx[..., j])[..., None] * image[row, np.clip(x0 + j - 1, 0, image.shape[1] - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def upscaled(image: np.ndarray, least: int) -> np.ndarray:
    """Enlarged so that the short side is at least `least`; 0 is off."""
    height, width = image.shape[:2]
    if not least or min(height, width) >= least:
        return image
    scale = least / min(height, width)
    return resized(image, int(height * scale), int(width * scale))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    y = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    return sampled(image, *np.meshgrid(y, x, indexing="ij"))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, the canvas as before."""
    height, width = image.shape[:2]
    y, x = np.meshgrid(np.arange(height) - height / 2, np.arange(width) - width / 2, indexing="ij")
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return sampled(image, s * x + c * y + height / 2, c * x - s * y + width / 2)


def deskewed(image: np.ndarray, reach: float = 20.0) -> np.ndarray:
    angle = skew(grey(image), reach)
    return rotated(image, angle) if angle else image


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts dark from light with the largest variance between."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(gray: np.ndarray, reach: float = 20.0, step: float = 0.5) -> float:
    """Angle in degrees at which the sums of the rows vary most; 0 if under half a degree."""
    half = gray[::2, ::2]
    y, x = np.nonzero(half <= otsu(half))
    if not len(x):
        return 0.0
    best, angle = -1.0, 0.0
    for a in sorted(np.arange(-reach, reach + step / 2, step), key=abs):  # of like angles the smallest
        row = np.rint(y * np.cos(np.radians(a)) - x * np.sin(np.radians(a))).astype(int)
        if (v := np.bincount(row - row.min(), minlength=2 * sum(half.shape)).var()) > best:
            best, angle = v, float(a)
    return angle if abs(angle) >= 0.5 else 0.0


def median_blur(gray: np.ndarray, k: int) -> np.ndarray:
    if k <= 0:
        return gray
    k += k % 2 == 0
    padded = np.pad(gray, k // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (k, k)), axis=(2, 3)).astype(np.uint8)


def morph(gray: np.ndarray, k: int, grow: bool) -> np.ndarray:
    """Maximum (grow) or minimum of each k by k neighbourhood."""
    if k <= 1:
        return gray
    padded = np.pad(gray, (k // 2, k - 1 - k // 2), mode="edge")
    seen = np.lib.stride_tricks.sliding_window_view(padded, (k, k))
    return seen.max(axis=(2, 3)) if grow else seen.min(axis=(2, 3))


def inverted(gray: np.ndarray) -> np.ndarray:
    return np.repeat((255 - gray)[..., None], 3, axis=2)


def bordered(image: np.ndarray, px: int = 10) -> np.ndarray:
    pad = ((px, px), (px, px)) + ((0, 0),) * (image.ndim - 2)
    return np.pad(image, pad, constant_values=255)


def opened(mask: np.ndarray, high: int, wide: int) -> np.ndarray:
    """What of a mask a rectangle of this size fits into."""
    for size, axis in ((high, 0), (wide, 1)):
        if size > 1:
            padded = np.pad(mask, [(size - 1 - size // 2, size // 2) if i == axis else (0, 0) for i in range(2)], constant_values=True)
            mask = np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis).all(axis=-1)
            padded = np.pad(mask, [(size // 2, size - 1 - size // 2) if i == axis else (0, 0) for i in range(2)], constant_values=False)
            mask = np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis).any(axis=-1)
    return mask


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue (0 to 179), saturation and value (0 to 255)."""
    x = image.astype(np.float64)
    most, least = x.max(axis=2), x.min(axis=2)
    range_ = np.where(most > least, most - least, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.select([most == least, most == r, most == g], [0 * r, (g - b) / range_, 2 + (b - r) / range_], 4 + (r - g) / range_)
    sat = np.where(most > 0, (most - least) / np.where(most > 0, most, 1), 0)
    return np.stack([np.rint(hue * 30) % 180, np.rint(sat * 255), most], axis=2).astype(np.uint8)


def inpainted(image: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Masked pixels from the known ones within the radius, near ones more, layer by layer from the rim."""
    out, known = image.astype(np.float64), ~mask
    if mask.all():
        return image
    places = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    while not known.all():
        rim = ~known & morph(known.astype(np.uint8), 3, grow=True).astype(bool)
        y, x = np.nonzero(rim)
        total, weight = np.zeros((len(y), out.shape[2])), np.zeros(len(y))
        for dy, dx in places:
            v, u = y + dy, x + dx
            inside = (v >= 0) & (v < out.shape[0]) & (u >= 0) & (u < out.shape[1])
            v, u = np.clip(v, 0, out.shape[0] - 1), np.clip(u, 0, out.shape[1] - 1)
            w = (inside & known[v, u]) / (dy * dy + dx * dx)
            total += w[:, None] * out[v, u]
            weight += w
        out[y, x] = total / weight[:, None]
        known = known | rim
    return np.rint(out).astype(np.uint8)


def without_grid(image: np.ndarray, settings: dict = DEFAULTS) -> np.ndarray:
    """Without long straight lines of the grid's colour."""
    tones = hsv(image)
    colour = ((tones >= settings["grid_hsv_lo"]) & (tones <= settings["grid_hsv_hi"])).all(axis=2)
    size = max(15, int(min(colour.shape) * settings["grid_min_len_ratio"]))
    lines = opened(colour, 1, size) | opened(colour, size, 1)
    if not lines.any():
        return image
    return inpainted(image, morph(lines.astype(np.uint8), 3, grow=True).astype(bool), settings["grid_inpaint_radius"])


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = _TO_XYZ.sum(axis=1)


def lab(image: np.ndarray) -> np.ndarray:
    x = image / 255.0
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92) @ _TO_XYZ.T / _WHITE
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=2)


def from_lab(tones: np.ndarray) -> np.ndarray:
    y = (tones[..., 0] + 16) / 116
    f = np.stack([y + tones[..., 1] / 500, y, y - tones[..., 2] / 200], axis=2)
    x = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE @ np.linalg.inv(_TO_XYZ).T
    x = np.where(x > 0.0031308, 1.055 * np.maximum(x, 0) ** (1 / 2.4) - 0.055, 12.92 * x)
    return np.clip(np.rint(x * 255), 0, 255).astype(np.uint8)


def equalised(plane: np.ndarray, limit: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Histogram equalisation by tiles with clipped counts, tiles blended between their middles (CLAHE)."""
    rows, cols = grid
    height, width = plane.shape
    padded = np.pad(plane, ((0, -height % rows), (0, -width % cols)), mode="reflect" if min(plane.shape) > max(grid) else "edge")
    h, w = padded.shape[0] // rows, padded.shape[1] // cols
    tables = np.empty((rows, cols, 256))
    most = max(1, int(limit * h * w / 256))
    for i in range(rows):
        for j in range(cols):
            n = np.bincount(padded[i * h : (i + 1) * h, j * w : (j + 1) * w].ravel(), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            if rest := over % 256:
                n[:: max(256 // rest, 1)][:rest] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(n) * 255 / (h * w)), 0, 255)
    place = lambda size, tile, count: (np.arange(size) / tile - 0.5, count)
    parts = []
    for at, count in (place(height, h, rows), place(width, w, cols)):
        low = np.floor(at).astype(int)
        parts.append((np.clip(low, 0, count - 1), np.clip(low + 1, 0, count - 1), at - low))
    (y0, y1, ty), (x0, x1, tx) = parts
    at = lambda y, x: tables[y[:, None], x[None, :], plane]
    top = at(y0, x0) * (1 - tx) + at(y0, x1) * tx
    low = at(y1, x0) * (1 - tx) + at(y1, x1) * tx
    return np.rint(top * (1 - ty[:, None]) + low * ty[:, None]).astype(np.uint8)


def lit_evenly(image: np.ndarray, limit: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Lightness equalised by tiles, colours kept."""
    tones = lab(rgb(image))
    tones[..., 0] = equalised(np.clip(np.rint(tones[..., 0] * 2.55), 0, 255).astype(np.uint8), limit, grid) / 2.55
    return from_lab(tones)


def ink(image: np.ndarray, settings: dict = DEFAULTS) -> np.ndarray:
    """255 where a pixel is ink: off the commonest colour of a sample in value or saturation, and nearer to another colour of its palette."""
    flat = image.reshape(-1, 3)
    chosen = np.random.default_rng(0).permutation(len(flat))[: max(1, int(len(flat) * settings["sample_fraction"]))]
    sample = flat[np.sort(chosen)].astype(int)
    coarse = (sample >> 2 << 2) + 2
    codes, times = np.unique(coarse @ [65536, 256, 1], return_counts=True)
    paper = np.array([codes[times.argmax()] >> 16, codes[times.argmax()] >> 8 & 255, codes[times.argmax()] & 255])

    def off(pixels: np.ndarray) -> np.ndarray:
        tones = lambda c: (c.max(axis=-1) / 255, np.where(c.max(axis=-1) > 0, (c.max(axis=-1) - c.min(axis=-1)) / np.maximum(c.max(axis=-1), 1), 0))
        (v, s), (v0, s0) = tones(pixels.astype(float)), tones(paper.astype(float))
        return (np.abs(v - v0) >= settings["value_threshold"]) | (np.abs(s - s0) >= settings["sat_threshold"])

    found = sample[off(sample)].astype(float)
    if len(found) < settings["num_colors"]:  # too little ink for a sample
        found = flat[off(flat)].astype(float)
    out = np.zeros(len(flat), np.uint8)
    if len(found):
        order = found[np.argsort(found.sum(axis=1), kind="stable")]
        middle = order[np.linspace(0, len(order) - 1, settings["num_colors"] - 1).astype(int)]
        nearest = lambda x, c: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for _ in range(40):
            own = nearest(found, middle)
            new = np.array([found[own == k].mean(axis=0) if (own == k).any() else middle[k] for k in range(len(middle))])
            if np.abs(new - middle).max() < 0.5:
                break
            middle = new
        candidates = np.flatnonzero(off(flat))
        palette = np.concatenate((paper[None].astype(float), middle))
        for at in range(0, len(candidates), 65536):
            part = candidates[at : at + 65536]
            out[part] = (nearest(flat[part].astype(float), palette) > 0) * 255
    return out.reshape(image.shape[:2])


def thinned_or_thickened(mask: np.ndarray, settings: dict = DEFAULTS) -> np.ndarray:
    for _ in range(settings["morph_iters"] if settings["morph_op"] else 0):
        mask = morph(mask, settings["morph_ksize"], settings["morph_op"] == "dilate")
    return mask


def geometric(image: np.ndarray, settings: dict = DEFAULTS) -> np.ndarray:
    """The part that moves pixels: enlarging and deskewing."""
    image = upscaled(rgb(image), settings["rescale_min_dim"])
    return deskewed(image, settings["deskew_max_angle"]) if settings["deskew"] else image


def photometric(image: np.ndarray, settings: dict = DEFAULTS) -> np.ndarray:
    """The part that changes pixels where they are, but for the border: light, noise, grid, ink, black on white."""
    image = lit_evenly(image, settings["clahe_clip_limit"], settings["clahe_tile_grid"])
    if settings["denoise_ksize"]:
        image = np.stack([median_blur(image[..., c], settings["denoise_ksize"]) for c in range(3)], axis=2)
    image = without_grid(image, settings) if settings["remove_grid"] else image
    out = inverted(thinned_or_thickened(ink(image, settings), settings))
    return bordered(out, settings["border_px"]) if settings["border_px"] else out


def preprocessed(image: np.ndarray, changes: dict | None = None) -> np.ndarray:
    settings = {**DEFAULTS, **(changes or {})}
    return photometric(geometric(composite(image, settings["alpha_crop"]), settings), settings)


def with_boxes(image: np.ndarray, boxes: list[tuple[float, float, float, float]], colour: tuple[int, int, int] = (255, 0, 0), px: int = 2) -> np.ndarray:
    """The outlines of boxes (x, y, w, h) drawn in."""
    out = rgb(image).copy()
    for x, y, w, h in boxes:
        x1, y1, x2, y2 = (max(0, int(v)) for v in (x, y, x + w, y + h))
        for part in (np.s_[y1 : y1 + px, x1:x2], np.s_[max(0, y2 - px) : y2, x1:x2], np.s_[y1:y2, x1 : x1 + px], np.s_[y1:y2, max(0, x2 - px) : x2]):
            out[part] = colour
    return out


def side_by_side(left: np.ndarray, right: np.ndarray, most: int = 900) -> np.ndarray:
    """Both at one height, that of the first or `most`."""
    height = min(left.shape[0], most)
    return np.hstack([resized(rgb(x), height, max(1, int(x.shape[1] * height / x.shape[0]))) for x in (left, right)])
