"""Folders of the given tables; a plain module, since every folder has its own ``conftest``."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
