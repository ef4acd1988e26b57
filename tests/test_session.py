import os
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest

from tessella import session


def test_no_own_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_scratch_and_released(spark):
    def there(df):
        return os.path.isdir(urlparse(df._written_at).path)

    kept = session.written(spark.range(3))
    with session.scratch():
        inside = session.written(spark.range(4))
        assert there(inside) and inside.count() == 4
    assert not there(inside) and there(kept)
    session.released(kept)
    assert not there(kept)
