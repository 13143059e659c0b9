"""tallyloom: a Spark-native engine for retail sales extracts.

Sub-packages
------------
functions   Column builders (text, names, periods, numbers); no Python UDF in a hot path
operators   DataFrame -> DataFrame operators
sources     readers, header mapping and writers
plans       the registered queries and their SQL twins
streaming   command stream
llm         operators for training-data work; nothing else imports it
"""
