"""Model training on the conversion features: coercion, seeded stratified
split, three MLlib candidates, evaluation, champion and TreeSHAP importance."""
