"""quarrylight: evidence retrieval and question-answering analytics as Spark jobs.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame building blocks), ``plans``
(whole pipelines made of operators), ``streaming`` (incremental versions) and,
optionally, ``llm`` (operators for training-data preparation, which nothing
else imports).
"""
