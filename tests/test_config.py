import pytest

from branchlight.config import LLMConfig, TreeConfig


def test_defaults_and_aliases():
    assert (TreeConfig().max_branches, TreeConfig().leaf_target) == (5, 10)
    assert TreeConfig.of(leaf_capacity=7, min_samples_to_split=9).leaf_target == 7
    assert TreeConfig.of(split_mode="adaptive", leaf_capacity=7, min_samples_to_split=9).leaf_target == 9
    assert TreeConfig.of(leaf_target=3, leaf_capacity=7).leaf_target == 3
    assert TreeConfig.of(unknown=1, rebalance={"every_n_inserts": 5, "x": 1}).rebalance.every_n_inserts == 5


@pytest.mark.parametrize("bad", [{"max_branches": 1}, {"leaf_target": 0}, {"split_mode": "x"}, {"parent_dispersion_decay": 1.1}, {"min_split_gain": -1}, {"pca_dims": 1}, {"pca_dims": 300}, {"pca_dims": 8, "pca_warmup": 4}, {"pca_mode": "x"}, {"min_cluster_size": 0}])
def test_bad_values(bad):
    with pytest.raises(ValueError):
        TreeConfig(**bad)


def test_unknown_algorithm_and_provider():
    with pytest.raises(NotImplementedError):
        TreeConfig(split_algo="x")
    with pytest.raises(ValueError):
        LLMConfig(provider="x")
