"""quire: document-structure analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. The subpackage
``llm`` holds the training-data operators; nothing else imports it.
"""
