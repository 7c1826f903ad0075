import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rasterlab.functions import kernels as K

RNG = np.random.default_rng(0)


def test_identities():
    image = RNG.random((7, 9))
    assert np.allclose(K.resize_bilinear(image, 7, 9), image)
    assert np.allclose(K.resize_nearest(image, 7, 9), image)
    assert np.allclose(K.rotate(image, 0.0), image)
    assert np.allclose(K.rotate(image, 0.0, nearest=True), image)
    for _ in range(3):
        image = RNG.random((5, 5))
        assert np.allclose(np.rot90(np.rot90(image, 3), 1), image)


def test_bilinear_by_hand():
    assert np.allclose(K.resize_bilinear(np.array([[0.0, 1.0]]), 1, 4), [[0.0, 0.25, 0.75, 1.0]])
    assert np.allclose(K.resize_nearest(np.array([[1, 2, 3, 4]]), 1, 2), [[2, 4]])


def test_pad_keeps_larger_images():
    assert K.pad(np.ones((2, 9)), 4).shape == (4, 9)
    assert K.pad(np.ones((2, 2)), 4).sum() == 4


def test_constant_image_keeps_its_inside_under_blur():
    out = K.blur(np.full((9, 9), 0.5), 1.0)
    assert np.allclose(out[2:-2, 2:-2], 0.5) and out[0, 0] < 0.5


def test_sobel_by_hand():
    image = np.zeros((3, 3))
    image[:, 2] = 1.0
    assert K.sobel(image)[1, 1] == 4.0
    assert K.sobel(np.zeros((4, 4))).sum() == 0


def test_morphology_by_hand():
    mask = np.zeros((7, 7), bool)
    mask[2:5, 2:5] = True
    assert K.dilate(mask, 5).sum() == 49
    assert (K.morph_close(mask) | mask == K.morph_close(mask)).all()
    corner = np.zeros((7, 7), bool)
    corner[:2, :2] = True  # the corner has no neighbour to lose, and the second step shifts it by one
    assert (K.morph_open(np.eye(7, dtype=bool)) == corner).all()
    assert (K.dilate(K.dilate(mask, 5), 5) == K.dilate(mask, 9)).all()


def brute_components(mask):
    h, w = mask.shape
    out = np.full((h, w), -1)
    for start in range(h * w):
        y, x = divmod(start, w)
        if not mask[y, x] or out[y, x] >= 0:
            continue
        stack = [(y, x)]
        out[y, x] = start
        while stack:
            a, b = stack.pop()
            for p in range(max(0, a - 1), min(h, a + 2)):
                for q in range(max(0, b - 1), min(w, b + 2)):
                    if mask[p, q] and out[p, q] < 0:
                        out[p, q] = start
                        stack.append((p, q))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.floats(0.1, 0.9), st.integers(0, 10**6))
def test_components(h, w, share, seed):
    mask = np.random.default_rng(seed).random((h, w)) < share
    assert (K.components(mask) == brute_components(mask)).all()


def test_components_on_boards():
    board = np.indices((6, 6)).sum(axis=0) % 2 == 0
    assert set(np.unique(K.components(board))) == {-1, 0}
    assert (K.components(np.zeros((3, 4), bool)) == -1).all()


def test_grow_small():
    label = K.components(np.pad(np.ones((3, 3), bool), 8))
    assert K.grow_small(label, 8).sum() == 11 * 11
    assert K.grow_small(label, 10).sum() == 0
    big = K.components(np.pad(np.ones((10, 10), bool), 6))
    assert K.grow_small(big, 8).sum() == 100


def test_softmax_is_stable():
    assert np.allclose(K.softmax(np.array([[1000.0, 1000.0]])), 0.5)


def test_ship_enhancement_leaves_images_without_ships():
    probs = np.full((8, 8, 5), 0.2)
    probs[..., 3] = 0.1
    assert K.ship_enhancement(probs, 3, 2, 0.25, 8, 1.35, 0.7) is probs
    probs[2:6, 2:6] = [0.1, 0.1, 0.2, 0.6, 0.0]
    out = K.ship_enhancement(probs, 3, 2, 0.25, 8, 1.35, 0.7)
    assert np.allclose(out.sum(axis=-1), 1.0) and out[3, 3, 3] > 0.6 and out[3, 3, 2] < 0.2


@pytest.mark.parametrize("angle", [0.1, -0.3])
def test_rotation_keeps_range(angle):
    out = K.rotate(RNG.random((8, 8, 3)), angle)
    assert out.shape == (8, 8, 3) and out.min() >= 0 and out.max() <= 1
