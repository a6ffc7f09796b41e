import json

import pytest

from sourceloom.sources import config


def written(tmp_path, data, name="c.json"):
    path = tmp_path / name
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_profile_before_defaults(tmp_path):
    settings = config.load_settings(written(tmp_path, '[defaults]\nworkdir = "/d"\n\n[profile.sample]\nworkdir = "/s"\n', "c.toml"))
    assert [config.profile_value(settings, p, "workdir") for p in ("sample", "other", None)] == ["/s", "/d", "/d"]
    assert config.profile_value(settings, "sample", "absent") is None
    assert config.load_settings(None) == {} == config.load_settings(str(tmp_path / "none.toml"))


def test_registry_round_trip_and_missing_file(tmp_path):
    path = str(tmp_path / "r.json")
    assert config.load_registry(path) == []
    config.save_registry([("b", "Bee", "person", ["x", "b", "x"]), ("a", "Ay", "organization", [])], path)
    assert config.load_registry(path) == [("a", "Ay", "organization", [], 0), ("b", "Bee", "person", ["b", "x"], 1)]
    with pytest.raises(config.ConfigError, match="entities.z"):
        config.load_registry(written(tmp_path, {"entities": {"z": {}}}))
    with pytest.raises(config.ConfigError):
        config.load_registry(written(tmp_path, {}))


@pytest.mark.parametrize("bad", [
    [], {"default": []}, {"default": ["a,b"]}, {"default": [" a"]}, {"rules": {}}, {"rules": [{"unit": "X"}]},
    {"rules": [{"unit": "X", "audiences": []}]}, {"rules": [{"audiences": ["a"]}]}, {"rules": [{"unit": "X", "audiences": [1]}]}])
def test_malformed_audiences_are_refused(tmp_path, bad):
    with pytest.raises(config.ConfigError):
        config.load_acl(written(tmp_path, bad))


def test_audiences(tmp_path):
    assert config.load_acl(None) is None
    given = {"rules": [{"unit": "Clients", "audiences": ["sales"], "note": "x"}]}
    assert config.load_acl(written(tmp_path, given)) == {"default": ["all"], "rules": [{"unit": "Clients", "audiences": ["sales"]}]}


def test_all_problems_at_once(tmp_path):
    with pytest.raises(config.ConfigError) as found:
        config.load_taxonomy(written(tmp_path, {"rules": [{"type": "a", "verdict": "NO"}, {"verdict": "IN"}, {"type": "c", "verdict": "IN", "pattern": "("}]}))
    assert len(str(found.value).splitlines()) == 3
    assert config.load_taxonomy(written(tmp_path, {}))["fallback"] == {"type": "other", "verdict": "MAYBE"}
