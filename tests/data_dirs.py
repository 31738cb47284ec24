"""Folders of the given tables."""

SF1 = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
