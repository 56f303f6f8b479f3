"""tessera: text records to embedding vectors, as Spark DataFrame jobs.

Sub-packages:
  sources    reading records, list attributes, tokens, change sets, vectors
  functions  column expressions (tokenising, hashing, ordinals, vector math)
  operators  embedders (chars, words, tf-idf, hashed, model), PCA, k-NN, metrics
  sinks      vector store (append, replace, delete, upsert, export, collection)
  plans      composed jobs: encode, re-embed, score, and the registered queries
  streaming  throttle, job state, token gate, re-embed and scoring streams
"""

__version__ = "0.1.0"
