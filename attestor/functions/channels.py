"""Channels that may go beside an image's colours, and the stages of preprocessing."""

from __future__ import annotations

import numpy as np

from . import kernels as k
from .regions import boundary_proxy, filled, to_hsv


def _mask(f):
    return lambda i: f(i).astype(np.uint8) * 255


def lightness(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(k.to_lab(image)[..., 0] * 2.55), 0, 255).astype(np.uint8)


CHANNELS = {
    "lab_l": lightness,
    "zero_mask": lambda i: np.zeros(i.shape[:2], np.uint8),
    "clahe_l": lambda i: k.clahe(lightness(i)),
    "hsv_v": lambda i: k.as_bytes(to_hsv(i)[..., 2]),
    "illumination_gray": k.invariant_gray,
    "shade_attenuated": k.shade_attenuated,
    "chromaticity_red": k.red_chromaticity,
    "optical_density_pc1": k.density_component,
    "dark_artifact_mask": _mask(k.dark_artifacts),
    "black_frame_mask": _mask(k.black_frame),
    "vignette_mask": _mask(lambda i: k.vignette(*i.shape[:2])),
    "specular_mask": _mask(k.specular),
    "superpixel_boundary": boundary_proxy,
    "saliency": lambda i: k.as_bytes(k.saliency(i)),
    "lbp_texture": k.local_binary,
    "gabor_texture": k.gabor,
    "wavelet_energy": k.wavelet_energy,
    "gradient": lambda i: k.stretch(np.hypot(*k.sobel(k.luminance(i)))),
}
#: Other names of the channels.
ALIASES = {
    "zeros": "zero_mask", "empty_mask": "zero_mask", "v_star": "hsv_v", "illum_gray": "illumination_gray", "illumination_invariant_gray": "illumination_gray",
    "shading_attenuated": "shade_attenuated", "shade_attenuated_gray": "shade_attenuated", "red_chromaticity": "chromaticity_red", "rgb_norm_band": "chromaticity_red",
    "od_pc1": "optical_density_pc1", "pigment_pc1": "optical_density_pc1", "melanin_proxy": "optical_density_pc1", "hair_mask": "dark_artifact_mask", "artifact_mask": "dark_artifact_mask",
    "frame_mask": "black_frame_mask", "falloff_mask": "vignette_mask", "highlight_mask": "specular_mask", "slic_boundary": "superpixel_boundary", "region_boundary": "superpixel_boundary",
    "saliency_proxy": "saliency", "texture_lbp": "lbp_texture", "texture_gabor": "gabor_texture", "frequency_energy": "wavelet_energy", "high_frequency_energy": "wavelet_energy",
}
#: Names that stand for no channel.
NONE = ("none", "", "false")


def with_channel(image: np.ndarray, name: str | None) -> np.ndarray:
    """The image with one more channel, by name or alias in any case; ValueError lists the known ones."""
    name = str(name).lower()
    if name in NONE:
        return image.copy()
    name = ALIASES.get(name, name)
    if name not in CHANNELS:
        raise ValueError(f"unknown channel {name!r}; known: {', '.join(sorted(CHANNELS))}")
    return np.concatenate([image, CHANNELS[name](image)[..., None].astype(np.uint8)], axis=-1)


#: Stages of preprocessing in the order in which they run, whatever order they are configured in.
STAGES = ["restoration", "hair_removal", "color_constancy", "gamma", "retinex", "shading", "specular", "clahe", "contrast_stretch", "filter", "sharpen", "modulation", "extra_channel"]


def preprocess(image: np.ndarray, config: dict[str, dict]) -> np.ndarray:
    """Runs the stages that the configuration enables."""
    if unknown := set(config) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    each = lambda i, f: np.stack([np.clip(np.rint(f(i[..., c])), 0, 255).astype(np.uint8) for c in range(3)], -1)
    steps = {
        "restoration": lambda i, c: each(i, lambda g: k.deblock(k.wiener(g, **c))),
        "hair_removal": lambda i, c: filled(i, k.dark_artifacts(i, **c)),
        "color_constancy": lambda i, c: k.shades_of_gray(i, **c),
        "gamma": lambda i, c: k.gamma(i, c.get("value", 1.0)),
        "retinex": lambda i, c: k.retinex(i, **c),
        "shading": lambda i, c: k.shading_corrected(i, **c),
        "specular": lambda i, c: filled(i, k.specular(i, **c)),
        "clahe": lambda i, c: k.on_lightness(i, lambda g: k.clahe(g, **c)),
        "contrast_stretch": lambda i, c: k.on_lightness(i, lambda g: k.stretch(g.astype(float), **c)),
        "filter": lambda i, c: k.filtered(i, c.get("kind", "median"), c.get("size", 3)),
        "sharpen": lambda i, c: k.unsharp(i, **c),
        "modulation": lambda i, c: k.modulated(i, **c)[0],
        "extra_channel": lambda i, c: with_channel(i, c["name"]),
    }
    for name in STAGES:
        settings = dict(config.get(name, {"enabled": False}))
        if settings.pop("enabled", True):
            image = steps[name](image, settings)
    return image
