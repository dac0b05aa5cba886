"""Spark-native analytics over scanned volumes, fitted surfaces and rays.

Sub-packages
------------
``functions``  pure Column expressions (interpolation, weights, wraps, kernels)
``operators``  DataFrame operators (windows, joins, statistics, meshes, volumes)
``sources``    readers and writers of the domain's file formats
``plans``      the composite reports and the registered query catalogue
``streaming``  incremental versions of the operators that are additive
``llm``        operators for preparing training data; nothing else imports it
"""
