"""A stand-in for the HDF5 library: an npz archive whose names are the paths of the datasets."""

import numpy as np


class Group:
    def __init__(self, data, prefix):
        self._data, self._prefix = data, prefix

    def keys(self):
        return list(dict.fromkeys(n[len(self._prefix) :].split("/")[0] for n in self._data if n.startswith(self._prefix)))

    def __getitem__(self, key):
        name = self._prefix + key
        return self._data[name] if name in self._data else Group(self._data, name + "/")


class File(Group):
    def __init__(self, path, mode):
        try:
            data = dict(np.load(path, allow_pickle=False))
        except ValueError as e:
            raise OSError("no signature") from e
        super().__init__(data, "")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
